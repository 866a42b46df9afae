"""Nearest neighbours by learned partitions: a partitioned graph and a routing classifier."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geonear.session import materialize_measured

SAMPLE_ROWS = 6000  # rows on which the index is fitted; every row is indexed
ROWS_PER_PARTITION = 400
MAX_PARTITIONS = 64
NEIGHBOURS = 12  # links of a sampled row in the graph
HIDDEN = 128
TARGET_RECALL = 0.97  # on sampled rows kept from the fit; sets the number of probes
BLOCK_ROWS = 1024  # candidates that one task compares at a time, and queries
SEED = 7


@dataclass
class Router:
    """A classifier with one hidden layer from vectors to partitions."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    @property
    def partitions(self) -> int:
        return len(self.b2)

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def ranked(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` most probable partitions of each vector, best first."""
        return np.argsort(-self.scores(x), axis=1, kind="stable")[:, :n]


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` rows of largest inner product for each row, itself excluded."""
    out = []
    for i in range(0, len(x), 1024):
        s = x[i:i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out.append(np.argpartition(-s, min(k, len(x) - 1) - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator,
                       slack: float = 1.1, rounds: int = 8) -> np.ndarray:
    """A partition number per row: parts of nearly equal size that cut few links.

    Starts from splits at the median along the widest direction, then moves
    rows to the part of most of their neighbours while that part has room.
    """
    label = np.zeros(len(x), np.int64)

    def split(rows: np.ndarray, first: int, n: int) -> None:
        if n == 1:
            label[rows] = first
            return
        centred = x[rows] - x[rows].mean(axis=0)
        v = rng.standard_normal(x.shape[1])
        for _ in range(12):  # power iteration
            v = centred.T @ (centred @ v)
            v /= max(np.linalg.norm(v), 1e-30)
        order = rows[np.argsort(centred @ v, kind="stable")]
        cut = len(rows) * (n // 2) // n
        split(order[:cut], first, n // 2)
        split(order[cut:], first + n // 2, n - n // 2)

    split(np.arange(len(x)), 0, parts)
    room = int(np.ceil(len(x) / parts * slack))
    size = np.bincount(label, minlength=parts)
    back = [[] for _ in range(len(x))]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            back[j].append(i)
    around = [np.array(a + b) for a, b in zip(graph.tolist(), back)]
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(len(x)).tolist():
            votes = np.bincount(label[around[i]], minlength=parts)
            votes[(size >= room) & (np.arange(parts) != label[i])] = -1
            best = int(votes.argmax())
            if votes[best] > votes[label[i]]:
                size[label[i]] -= 1
                size[best] += 1
                label[i] = best
                moved += 1
        if not moved:
            break
    return label


def fit_router(sample: np.ndarray, partitions: int, k: int = 20, target: float = TARGET_RECALL,
               epochs: int = 40) -> Router:
    """Partition the sample's neighbour graph and learn to route to its parts.

    A tenth of the sample is kept from the fit. The router's ``probes`` are the
    least that find ``target`` of those rows' ``k`` nearest in the sample.
    """
    rng = np.random.default_rng(SEED)
    x = np.unique(np.asarray(sample, np.float64), axis=0)
    x = x[rng.permutation(len(x))]
    partitions = max(1, min(partitions, len(x) // 8))
    dim = x.shape[1]
    held = x[: len(x) // 10]
    fit = x[len(held):]
    unit = fit / np.maximum(np.linalg.norm(fit, axis=1, keepdims=True), 1e-30)
    graph = neighbour_graph(unit, max(1, min(NEIGHBOURS, len(fit) - 1))) if len(fit) > 1 else np.zeros((len(fit), 0), int)
    label = balanced_partition(unit, graph, partitions, rng) if partitions > 1 else np.zeros(len(fit), np.int64)
    p = [rng.standard_normal((dim, HIDDEN)) * np.sqrt(2 / dim), np.zeros(HIDDEN),
         rng.standard_normal((HIDDEN, partitions)) * np.sqrt(1 / HIDDEN), np.zeros(partitions)]
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for _ in range(epochs if partitions > 1 else 0):
        order = rng.permutation(len(unit))
        for i in range(0, len(order), 128):
            rows = order[i:i + 128]
            a, y = unit[rows], label[rows]
            h = np.maximum(a @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(len(y)), y] -= 1
            z /= len(y)
            dh = (z @ p[2].T) * (h > 0)
            step += 1
            for j, g in enumerate((a.T @ dh, dh.sum(axis=0), h.T @ z, z.sum(axis=0))):
                first[j] = 0.9 * first[j] + 0.1 * g
                second[j] = 0.999 * second[j] + 0.001 * g * g
                p[j] = p[j] - 0.003 * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
    router = Router(*p, probes=partitions)
    if partitions > 1 and len(held):
        home = router.ranked(x, 1)[:, 0]
        truth = neighbour_graph(np.concatenate([held, fit]), max(1, min(k, len(x) - 1)))[: len(held)]
        rank = np.empty((len(held), partitions), np.int64)
        np.put_along_axis(rank, router.ranked(held, partitions), np.arange(partitions)[None, :], axis=1)
        needed = np.sort(np.take_along_axis(rank, home[truth], axis=1).reshape(-1)) + 1
        router.probes = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))])
    return router


def inner_products(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Products of all rows, summed in the same order wherever a pair stands: equal vectors get equal sums."""
    out = np.zeros((len(y), len(x)))
    for a, b in zip(y.T, np.ascontiguousarray(x.T)):
        out += a[:, None] * b[None, :]
    return out


def best_of(asking: np.ndarray, y: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
    """Per query the positions in ``ids`` (ascending) of its ``k`` best rows, their scores, and which are any."""
    s = inner_products(y, x)
    s[asking[:, None] == ids[None, :]] = -np.inf
    best = np.argsort(-s, axis=1, kind="stable")[:, :k]
    score = np.take_along_axis(s, best, axis=1)
    return best, score, score > -np.inf


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector takes part: ``dim`` finite components, not all zero, none null."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & ~bad & F.exists(vector, lambda v: v != 0)


def nearest_vectors(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dim: int | None = None,
    sample_rows: int = SAMPLE_ROWS,
    target_recall: float = TARGET_RECALL,
) -> DataFrame:
    """The ``k`` nearest rows found for every query row: ``query_id, rank, vec_id, score``.

    Nearness is the inner product in double precision, ties go to the smaller
    id; a row with the query's own id is no candidate. Rows whose vector is
    null, zero, not of ``dim`` components (by default those of the usable row
    with the smallest id), or has a null or non-finite one, take no part; nor
    do rows without an id. Copies of a vector all count.

    A bounded sample (``sample_rows``, smallest hashes of the id) is linked to
    its neighbours, the graph is cut into balanced parts, and a classifier
    learns a vector's part. Every row is indexed in its most probable part; a
    query looks into its several most probable ones, as many as reached
    ``target_recall`` on sampled rows kept from the fit. Parts are compared in
    blocks of ``BLOCK_ROWS`` rows with blocks of as many queries, so a part
    with a third of the rows is the work of many tasks; each pair of blocks
    sends on at most ``k`` rows per query, and none that scores below the
    query's ``k``-th in the sample, whose own finds count too. A repeated id
    asks once and is one candidate, with its best score.
    """
    spark = vectors.sparkSession
    # Single-precision vectors stay so; of any other numbers no digit is lost.
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    stored = "array<float>" if single else "array<double>"
    v = F.col(vector_col).cast(stored)
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(
        "id is not null")
    if dim is None:
        first = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & usable(F.col("v"), F.size("v"))).agg(
            F.min_by(F.size("v"), "id").alias("dim")).first()
        dim = first["dim"]
    id_type = rows.schema["id"].dataType
    if dim is None:
        return spark.createDataFrame([], f"query_id {id_type.simpleString()}, rank int, "
                                         f"vec_id {id_type.simpleString()}, score double")
    rows = rows.where(usable(F.col("v"), dim))
    n = rows.count()
    sample = rows.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(sample_rows).toArrow()
    parts = min(MAX_PARTITIONS, max(1, n // ROWS_PER_PARTITION))
    seen = np.argsort(sample.column("id").to_numpy(), kind="stable")
    seen_ids, seen_rows = sample.column("id").to_numpy()[seen], _matrix(sample.column("v"), dim)[seen]
    sent = spark.sparkContext.broadcast((fit_router(seen_rows, parts, k, target_recall), seen_ids, seen_rows))
    parts, probes = sent.value[0].partitions, sent.value[0].probes

    def place(batches):
        router, ids, x = sent.value
        for batch in batches:
            vectors_here = _matrix(batch.column("v"), dim)
            best = router.ranked(vectors_here, probes).astype(np.int32)
            # Only a query needs more than its own part.
            wanted = np.where(batch.column("q").to_numpy(zero_copy_only=False), probes, 1)
            parts = best[np.arange(probes)[None, :] < wanted[:, None]]
            ends = np.concatenate([[0], np.cumsum(wanted)]).astype(np.int32)
            # What a query finds in the sample: its least score bounds what else is worth sending.
            seeds: list = [None] * len(best)
            asking = np.flatnonzero(wanted == probes) if probes > 1 else np.flatnonzero(
                batch.column("q").to_numpy(zero_copy_only=False))
            own = batch.column("id").to_numpy(zero_copy_only=False)
            for i in range(0, len(asking), 64):
                rows_here = asking[i:i + 64]
                at, score, any_ = best_of(own[rows_here], vectors_here[rows_here], ids, x, k)
                for r, a, sc, ok in zip(rows_here.tolist(), at, score, any_):
                    seeds[r] = [{"vec_id": j, "score": v} for j, v in zip(ids[a[ok]].tolist(), sc[ok].tolist())]
            kind_of = pa.list_(pa.struct([("vec_id", batch.schema.field("id").type), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(ends, parts), pa.array(seeds, kind_of)],
                names=["id", "v", "q", "parts", "seeds"])

    kind = id_type.simpleString()
    placed, _ = materialize_measured(
        rows.mapInArrow(place, f"id {kind}, v {stored}, q boolean, parts array<int>, "
                              f"seeds array<struct<vec_id: {kind}, score: double>>"), "vectors", n=F.count("*"))
    home, asked = F.col("parts")[0], F.explode("parts").alias("part")
    counts = {r["part"]: r for r in placed.select(F.col("q"), asked, home.alias("home")).groupBy("part").agg(
        F.count_if(F.col("part") == F.col("home")).alias("rows"), F.count_if("q").alias("queries")).collect()}
    # How many blocks a part's rows and its queries make: one number per part.
    blocks = [[max(1, -(-counts[p][what] // BLOCK_ROWS)) if p in counts else 1 for p in range(parts)]
              for what in ("rows", "queries")]
    of_rows, of_queries = (F.element_at(F.array(*map(F.lit, b)), F.col("part") + 1).cast("long") for b in blocks)
    dealt = F.xxhash64("id")
    candidates = placed.select("id", "v", home.alias("part")).select(
        "id", "v", "part", F.pmod(dealt, of_rows).alias("row_block"),
        F.explode(F.sequence(F.lit(0).cast("long"), of_queries - 1)).alias("query_block"))
    bound = F.when(F.size("seeds") >= k, F.element_at("seeds", k)["score"]).otherwise(float("-inf"))
    queries = placed.where("q").dropDuplicates(["id"]).select("id", "v", bound.alias("bound"), asked).select(
        "id", "v", "bound", "part", F.explode(F.sequence(F.lit(0).cast("long"), of_rows - 1)).alias("row_block"),
        F.pmod(dealt, of_queries).alias("query_block"))

    def compare(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, asking = left.column("id").to_numpy(), right.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], _matrix(left.column("v"), dim)[order] if len(order) else np.zeros((0, dim))
        y = _matrix(right.column("v"), dim) if len(asking) else np.zeros((0, dim))
        bounds = right.column("bound").to_numpy()
        found = []
        for i in range(0, len(asking) if len(ids) else 0, 64):
            own = asking[i:i + 64]
            best, score, any_ = best_of(own, y[i:i + 64], ids, x, k)
            keep = any_ & (score >= bounds[i:i + 64, None])
            found.append((np.repeat(own, keep.sum(axis=1)), ids[best][keep], score[keep]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [ids[:0], ids[:0], np.zeros(0)]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    key = ["part", "row_block", "query_block"]
    met = candidates.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(
        compare, f"query_id {kind}, vec_id {kind}, score double")
    seeds = placed.where("q").select(F.col("id").alias("query_id"), F.inline("seeds"))
    met = met.unionByName(seeds).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
