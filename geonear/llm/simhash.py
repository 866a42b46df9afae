"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified distances."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geonear.llm.common import OWN, texts_of, with_fields
from geonear.llm.components import connected_components
from geonear.session import materialize

WORDS = 3  # words of a shingle
DISTANCE = 2  # differing bits up to which fingerprints link
BLOCKS = 5  # pieces of a fingerprint; DISTANCE bits leave BLOCKS - DISTANCE of them equal
PAIR_BUCKET = 32  # fingerprints of a bucket up to which its pairs are compared
SEED = 42


def fingerprint(text: str, words: int = WORDS) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes.

    A-Z are lower-cased, words are parted by ASCII white space, repeated
    shingles count again; fewer words make one shingle, none give zero.
    """
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII rules only
    if not tokens:
        return 0
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(tokens), SEED)]
    else:
        line = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED)
                  for a, b in zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1:].tolist())]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i:i + (1 << 16)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fp",
                     words: int = WORDS) -> DataFrame:
    """``docs`` with the fingerprint of each text as a (signed) long. Null counts as empty."""
    base = docs.drop(out_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in texts_of(batch, text_col)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found.view(np.int64))], names=[*batch.schema.names, out_col])

    return base.mapInArrow(add, with_fields(base, **{out_col: T.LongType()}))


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Masks of every choice of ``blocks - distance`` blocks, as signed longs."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    pieces = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(pieces, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def close_links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS,
                pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Edges ``a, b`` whose components are those of "at most ``distance`` differing bits".

    ``fps`` has distinct longs ``fp``. Two close fingerprints agree in at
    least ``blocks - distance`` blocks, so they meet in the bucket of one such
    choice; the pairs of a bucket are compared bit by bit. A bucket of more
    than ``pair_bucket`` fingerprints isn't paired: two fingerprints within
    two bits share a *midpoint*, one bit or none away from either, and two that
    share a midpoint are within two bits. Its members are linked through their
    midpoints instead, of which each has 65, and at most 65 fingerprints meet
    in one. So no link is lost and none is added, and the work stays
    proportional to the members.
    """
    if distance > 2:
        raise ValueError("buckets beyond pair_bucket need a distance of at most 2")
    masks = block_masks(blocks, distance)
    keyed = fps.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("way", "block"),
    )
    shared = keyed.groupBy("way", "block").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(keyed.join(shared, ["way", "block"]), "simhash-buckets")
    few = members.where(F.col("n") <= pair_bucket).select("way", "block", "fp")
    pairs = (
        few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["way", "block"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
        .select("a", "b")
    )
    many = members.where(F.col("n") > pair_bucket).select("fp").distinct()
    if distance == 2:
        flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << j) - ((1 << 64) if j == 63 else 0)).cast("long")
                                                 for j in range(64)])
        met = many.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("mid"))
        stars = (
            met.groupBy("mid").agg(F.collect_list("fp").alias("fps"))  # at most 65
            .where("size(fps) > 1")
            .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
        )
    else:  # one bit: the neighbours themselves, looked up
        flips = F.array(*[F.lit((1 << j) - ((1 << 64) if j == 63 else 0)).cast("long") for j in range(64)])
        near = many.select(F.col("fp").alias("a"),
                           F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("b"))
        stars = near.join(many.withColumnRenamed("fp", "b"), "b", "left_semi").select("a", "b")
        if distance == 0:
            stars = stars.limit(0)
    return pairs.unionByName(stars)


def _grouped(docs_fp: DataFrame, distance: int) -> DataFrame:
    """``fp, root`` for the fingerprints that are linked to others."""
    links = close_links(docs_fp.select("fp").distinct(), distance)
    return connected_components(links, "simhash-components").select(F.col("node").alias("fp"), "root")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   distance: int = DISTANCE, words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``.

    ``component_id`` is the smallest id that can be reached over links between
    fingerprints at most ``distance`` bits apart, the row's own included. A
    null or empty text has the fingerprint zero and is linked like any other.
    Null ids are reached but never smallest; a group of null ids only has a
    null ``component_id``. Repeated rows keep their rows.

    Linking works on *distinct* fingerprints, so copies cost nothing.
    """
    rows = materialize(
        with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), words=words)
        .drop("text"), "simhash")
    roots = _grouped(rows, distance)
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    rooted = fps.join(roots, "fp", "left")
    least = rooted.where("root is not null").groupBy("root").agg(F.min("id").alias("component_id"))
    # Only fingerprints of several rows, or with links, must be told to their rows.
    linked = rooted.where("root is not null").join(least, "root").select("fp", "component_id")
    alone = rooted.where("root is null and n > 1").select("fp", F.col("id").alias("component_id"))
    told = linked.unionByName(alone).withColumn("told", F.lit(True))
    return rows.join(told, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("told"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               distance: int = DISTANCE, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each group, unchanged.

    The row with the smallest id stays; among rows of one id the one with the
    smallest digest of its text, and of rows equal in both, one.
    """
    key = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    rows = materialize(
        with_fingerprint(docs.select(F.col(id_col).alias("id"), key.alias("digest"),
                                     F.col(text_col).alias("text")), words=words).drop("text"), "simhash")
    roots = _grouped(rows, distance)
    # A null id sorts last, not first.
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest"))
    fps = rows.groupBy("fp").agg(best.alias("best"))
    winners = (
        fps.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root"))
        .agg(F.min("best").alias("best")).select(
            F.col("best.id").alias(f"{OWN}id"), F.col("best.digest").alias(f"{OWN}digest"))
    )
    tagged = docs.withColumn(f"{OWN}text", key)
    kept = tagged.join(
        winners,
        tagged[id_col].eqNullSafe(winners[f"{OWN}id"]) & (tagged[f"{OWN}text"] == winners[f"{OWN}digest"]),
        "left_semi")
    return kept.dropDuplicates([id_col, f"{OWN}text"]).select(*docs.columns)
