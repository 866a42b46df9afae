"""Packing: optimal length buckets, and token-budget batches inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geonear.llm.common import OWN, SPACES

MAX_TOKENS = 2048  # a longer document becomes several pieces
N_BUCKETS = 16
TOKEN_BUDGET = 1 << 15  # tokens of a batch, padding included
SHARD_ROWS = 50_000  # pieces that one task numbers


def word_count(text: Column) -> Column:
    """Words parted by ASCII white space; null and blank texts have none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACES}|{SPACES}$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACES, -1))).cast("long")


def optimal_boundaries(lengths: list[int], counts: list[int], n_buckets: int) -> list[int]:
    """Bucket lengths, ascending, that leave the least padding.

    Dynamic programming over the histogram: the best way to cover the first
    ``j`` lengths with ``b`` buckets ends in a bucket that starts after some
    ``i``; every row of a bucket is padded to the bucket's longest. Among
    equally good ways the earliest start wins.
    """
    size = len(lengths)
    if not size:
        return []
    l = np.asarray(lengths, np.float64)
    c = np.concatenate([[0.0], np.cumsum(np.asarray(counts, np.float64))])
    w = np.concatenate([[0.0], np.cumsum(np.asarray(counts, np.float64) * l)])
    # Padding of one bucket over lengths i..j-1: l[j-1] * rows - tokens.
    cost = np.full(size + 1, np.inf)
    cost[0] = 0.0
    starts = []
    for _ in range(min(n_buckets, size)):
        best, start = np.full(size + 1, np.inf), np.zeros(size + 1, np.int64)
        for j in range(1, size + 1):
            ways = cost[:j] + l[j - 1] * (c[j] - c[:j]) - (w[j] - w[:j])
            start[j] = int(ways.argmin())
            best[j] = ways[start[j]]
        starts.append(start)
        cost = best
    ends, j = [], size
    for start in reversed(starts):
        ends.append(int(lengths[j - 1]))
        j = int(start[j])
    return ends[::-1]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    length: Column | None = None,
    max_tokens: int = MAX_TOKENS,
    n_buckets: int = N_BUCKETS,
    token_budget: int = TOKEN_BUDGET,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Places of all documents in padded batches.

    Returns ``doc_id, piece, offset, n_tokens, bucket, bucket_tokens,
    batch_id, slot, padding``, one row per piece. ``length`` counts a row's
    tokens (words of ``text`` by default). A document of more than
    ``max_tokens`` makes several pieces, starting at ``offset``; one without
    tokens, or of null length, makes an empty piece. Nothing is dropped.

    The histogram has at most ``max_tokens + 1`` lengths however large the
    table, and is all that reaches the driver, which chooses at most
    ``n_buckets`` bucket lengths of least padding. Inside a bucket, batches
    take as many pieces as the budget holds at the bucket's length (one at
    least). A bucket is dealt over shards of about ``shard_rows`` pieces by a
    hash of the id, so that a bucket with most of the rows is numbered by many
    tasks; only the last batch of a shard may be part full. Rows that repeat
    an id and a length share a shard and get places of their own, in any
    order. Other columns are ignored.
    """
    if max_tokens < 1 or n_buckets < 1:
        raise ValueError("max_tokens and n_buckets must be at least 1")
    length = word_count(F.col("text")) if length is None else length
    total, piece = f"{OWN}total", F.col("piece")
    pieces = docs.select(F.col(id_col).alias("doc_id"), F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias(total)).select(
        "doc_id", total,
        F.explode(F.sequence(F.lit(0).cast("long"),
                             F.greatest(F.ceil(F.col(total) / max_tokens) - 1, F.lit(0)).cast("long"))).alias("piece"),
    ).select(
        "doc_id", "piece", (piece * max_tokens).alias("offset"),
        F.least(F.col(total) - piece * max_tokens, F.lit(max_tokens)).cast("long").alias("n_tokens"),
    )
    histogram = {r["n_tokens"]: r["n"] for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    lengths = sorted(histogram)
    ends = optimal_boundaries(lengths, [histogram[x] for x in lengths], n_buckets)
    shards, low = [], -1
    for end in ends:
        rows = sum(n for x, n in histogram.items() if low < x <= end)
        shards.append(-(-rows // shard_rows))
        low = end
    if not ends:  # an empty table
        ends, shards = [0], [1]
    known = F.array(*[F.lit(e).cast("long") for e in ends])
    dealt = F.array(*[F.lit(s).cast("long") for s in shards])
    capacity = F.array(*[F.lit(max(1, token_budget // max(e, 1))).cast("long") for e in ends])
    at = F.col("bucket") + 1
    placed = pieces.withColumn(
        "bucket", F.size(F.filter(known, lambda e: e < F.col("n_tokens"))).cast("long")
    ).withColumn("bucket_tokens", F.element_at(known, at.cast("int"))).withColumn(
        f"{OWN}shard", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), F.element_at(dealt, at.cast("int"))))
    order = Window.partitionBy("bucket", f"{OWN}shard").orderBy("doc_id", "piece", "n_tokens")
    room = F.element_at(capacity, at.cast("int"))
    return placed.withColumn(f"{OWN}n", F.row_number().over(order) - 1).select(
        "doc_id", "piece", "offset", "n_tokens", "bucket", "bucket_tokens",
        F.format_string("%d-%d-%d", "bucket", f"{OWN}shard", F.floor(F.col(f"{OWN}n") / room)).alias("batch_id"),
        (F.col(f"{OWN}n") % room).cast("long").alias("slot"),
        (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"),
    )
