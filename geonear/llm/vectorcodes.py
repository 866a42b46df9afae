"""Codes for vectors: integer codebooks per part, learned and applied through tries of distinct parts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geonear.llm.common import OWN, with_fields
from geonear.session import materialize, materialize_measured

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Integer components beyond this are set to it, so that all sums of squares fit 64 bits.
LIMIT = 1 << 24
#: Leaves whose distances stand in memory at once.
LEAVES = 8192

_VEC, _ERROR = f"{OWN}vector", f"{OWN}error"


@dataclass
class Codebooks:
    """Entries of all parts: ``entries[p]`` has a row per entry; vectors have ``width`` components."""

    width: int
    entries: list[np.ndarray]

    def text(self) -> str:
        """All integers by part, entry and position, joined by commas."""
        return ",".join(str(v) for part in self.entries for row in part.tolist() for v in row)


def part_bounds(width: int, parts: int) -> list[int]:
    """Where the parts of a vector begin, and its end; equal wherever ``width`` allows it."""
    return [width * i // parts for i in range(parts + 1)]


def trie_distances(rows: np.ndarray, entries: np.ndarray, leaves: int = LEAVES) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each of the distinct ``rows``, in lexicographic order, and its squared distance.

    The rows are the leaves of a trie with a level per dimension. It is walked
    depth first; a node holds the distances of its prefix to all entries, and
    each child adds its own dimension to them, once for all rows below. A
    subtree of at most ``leaves`` rows is finished level by level at once.
    """
    n, m = rows.shape
    nearest, least = np.zeros(n, np.int64), np.zeros(n, np.int64)
    stack = [(0, n, 0, np.zeros(len(entries), np.int64))]
    while stack:
        lo, hi, depth, held = stack.pop()
        if hi - lo > leaves and depth < m:
            column = rows[lo:hi, depth]
            starts = np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
            ends = np.r_[starts[1:], hi - lo]
            for a, b in zip(starts[::-1], ends[::-1]):
                stack.append((lo + a, lo + b, depth + 1, held + (column[a] - entries[:, depth]) ** 2))
            continue
        parent, above = np.zeros(hi - lo, np.int64), held[None, :]
        new = np.zeros(hi - lo, bool)
        new[:1] = True
        for d in range(depth, m):
            column = rows[lo:hi, d]
            new[1:] |= column[1:] != column[:-1]
            first = np.flatnonzero(new)
            above = above[parent[first]] + (column[first, None] - entries[None, :, d]) ** 2
            parent = np.cumsum(new) - 1
        best = np.argmin(above, axis=1)  # the first of equal ones: ties to the lower index
        nearest[lo:hi], least[lo:hi] = best[parent], above[np.arange(len(best)), best][parent]
    return nearest, least


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """Integer components of a batch of vectors; all have ``width`` components."""
    flat = batch.column(name).flatten().to_numpy(zero_copy_only=False).astype("f8")
    return np.clip(np.floor(flat * SCALE), -LIMIT, LIMIT).astype(np.int64).reshape(len(batch), width)


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows as byte strings whose order is the lexicographic order of the integers."""
    return np.ascontiguousarray((rows + (1 << 31)).astype(">u4")).view(f"V{4 * rows.shape[1]}").ravel()


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, the place of each row among them, and their counts."""
    order = np.lexsort(rows.T[::-1])
    ranked = rows[order]
    new = np.r_[True, (ranked[1:] != ranked[:-1]).any(axis=1)] if len(rows) else np.zeros(0, bool)
    place = np.empty(len(rows), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[new], place, np.bincount(place, minlength=int(new.sum()))


def usable(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Rows whose vector isn't null or empty and holds finite numbers only."""
    v = F.col(vector_col)
    return vectors.where(v.isNotNull() & (F.size(v) > 0)).where(
        F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))))


def distinct_parts(vectors: DataFrame, width: int, vector_col: str = "embedding", parts: int = PARTS) -> DataFrame:
    """All distinct parts of usable vectors of ``width``: ``part, value, n``, stored in trie order.

    Counted in a batch first, then in the task's and all tasks' aggregation; a
    part that a third of all vectors share is one row per task.
    """
    bounds = part_bounds(width, parts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, vector_col, width)
            for p, (a, b) in enumerate(zip(bounds, bounds[1:])):
                if a == b or not len(x):
                    continue
                rows, _, counts = _distinct(x[:, a:b])
                yield pa.record_batch([
                    pa.array(np.full(len(rows), p, np.int32)), pa.array(_keys(rows).tolist(), pa.binary()),
                    pa.array(counts.astype(np.int64))], names=["part", "value", "n"])

    counted = vectors.select(vector_col).mapInArrow(cut, "part int, value binary, n long").groupBy(
        "part", "value").agg(F.sum("n").alias("n"))
    return materialize(counted.repartitionByRange("part", "value").sortWithinPartitions("part", "value"), "vector-parts")


def _summed(found: DataFrame, books: Codebooks) -> DataFrame:
    """Sums over the parts nearest to each entry: ``part, entry, n, total``, at most one row per entry."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(e), e.shape[1] + 1), object) for e in books.entries]
        for batch in batches:
            part = batch.column("part").to_numpy()
            for p in np.unique(part).tolist():
                at = np.flatnonzero(part == p)
                raw = b"".join(batch.column("value").take(pa.array(at)).to_pylist())
                rows = np.frombuffer(raw, ">u4").astype(np.int64).reshape(len(at), -1) - (1 << 31)
                n = batch.column("n").to_numpy()[at]
                order = np.lexsort(rows.T[::-1])
                rows, n = rows[order], n[order]
                nearest, _ = trie_distances(rows, books.entries[p])
                for e in np.unique(nearest).tolist():
                    mine = nearest == e
                    totals[p][e] += [int(n[mine].sum()), *_weighted(rows[mine], n[mine])]
        for p, total in enumerate(totals):
            used = np.flatnonzero(total[:, 0] > 0) if total.shape[1] > 1 else np.zeros(0, int)
            yield pa.record_batch([
                pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)),
                pa.array([[str(v) for v in total[e]] for e in used], pa.list_(pa.string()))], names=["part", "entry", "sums"])

    partial = found.mapInArrow(walk, "part int, entry int, sums array<string>")
    # Decimals: a weighted sum over all vectors of a cluster may exceed 64 bits.
    return partial.select("part", "entry", F.posexplode("sums").alias("at", "v")).groupBy("part", "entry", "at").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).alias("total"))


def _weighted(rows: np.ndarray, n: np.ndarray) -> list[int]:
    """Column sums of rows that stand for ``n`` parts each."""
    if int(n.sum()) < (1 << 62) // LIMIT:
        return (rows * n[:, None]).sum(axis=0).tolist()
    return (rows.astype(object) * n.astype(object)[:, None]).sum(axis=0).tolist()


def fit_codebooks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS,
                  entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of ``vectors``, or None if no row is usable.

    They start as the parts of the ``entries`` smallest ids (nulls last, ties by
    the vectors themselves), whose first row fixes the width. Each round assigns
    every distinct part to its nearest entry and moves each used entry to the
    floor of the mean of its parts, weighted by how many vectors have them.

    The driver holds the codebooks alone, ``entries`` vectors, and gets as many
    rows of sums per round.
    """
    kept = usable(vectors.select(id_col, vector_col), vector_col)
    first = kept.orderBy(F.asc_nulls_last(id_col), vector_col).limit(1).collect()
    if not first:
        return None
    width = len(first[0][vector_col])
    kept = kept.where(F.size(vector_col) == width)
    start = kept.orderBy(F.asc_nulls_last(id_col), vector_col).limit(entries).collect()
    x = np.clip(np.floor(np.array([r[vector_col] for r in start], "f8") * SCALE), -LIMIT, LIMIT).astype(np.int64)
    bounds = part_bounds(width, parts)
    books = Codebooks(width, [x[:, a:b].copy() for a, b in zip(bounds, bounds[1:])])
    found = distinct_parts(kept, width, vector_col, parts) if rounds else None
    for _ in range(rounds):
        sums: dict[tuple[int, int], dict[int, int]] = {}
        for r in _summed(found, books).collect():
            sums.setdefault((r["part"], r["entry"]), {})[r["at"]] = int(r["total"])
        for (p, e), total in sums.items():
            books.entries[p][e] = [total[i + 1] // total[0] for i in range(books.entries[p].shape[1])]
    return books


def encode_vectors(vectors: DataFrame, books: Codebooks | None, vector_col: str = "embedding") -> DataFrame:
    """The usable rows of ``vectors`` with ``code`` and ``error``, in place of columns of these names.

    ``code`` has two hex digits per part, the index of its nearest entry (ties
    to the lower one); ``error`` is the sum of the squared distances in
    integers. Rows with another width than the codebooks' are left out too, and
    so is everything without codebooks. The distinct parts of a batch form the
    tries that find the entries.
    """
    kept = usable(vectors, vector_col)
    kept = kept.where(F.size(vector_col) == books.width) if books else kept.where(F.lit(False))
    kept = kept.drop("code", "error")
    schema = with_fields(kept, code=T.StringType(), error=T.LongType())
    if books is None:
        return kept.withColumns({"code": F.lit("").cast("string"), "error": F.lit(0).cast("long")})
    bounds = part_bounds(books.width, len(books.entries))
    digits = np.array([f"{i:02x}" for i in range(256)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, vector_col, books.width)
            error = np.zeros(len(x), np.int64)
            code = np.zeros((len(x), len(books.entries)), np.int64)
            for p, (a, b) in enumerate(zip(bounds, bounds[1:])):
                if a == b:
                    continue
                rows, place, _ = _distinct(x[:, a:b])
                nearest, least = trie_distances(rows, books.entries[p])
                code[:, p] = nearest[place]
                error += least[place]
            text = ["".join(r) for r in digits[code].tolist()]
            yield pa.record_batch([*batch.columns, pa.array(text, pa.string()), pa.array(error)],
                                  names=[*batch.schema.names, "code", "error"])

    return kept.mapInArrow(encode, schema)


def decode_vectors(coded: DataFrame, books: Codebooks) -> DataFrame:
    """``coded`` with the column ``decoded``: the entries of its ``code``, scaled back to numbers."""
    schema = with_fields(coded.drop("decoded"), decoded=T.ArrayType(T.DoubleType()))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = pc.fill_null(batch.column("code"), "").to_pylist()
            out = [[v / SCALE for p, e in enumerate(books.entries) for v in e[int(c[2 * p:2 * p + 2], 16)].tolist()]
                   if c else None for c in codes]
            yield pa.record_batch([*batch.columns, pa.array(out, pa.list_(pa.float64()))],
                                  names=[*batch.schema.names, "decoded"])

    return coded.drop("decoded").mapInArrow(decode, schema)


def compress_vectors(vectors: DataFrame, label: Column | None = None, id_col: str = "vec_id",
                     vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
                     rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """Coded rows, with ``label_error`` (the error of all rows of that label), and their codebooks.

    Rows whose vector is null, empty or holds a null, NaN or infinity are left
    out, as are those of another width than that of the smallest id (a table
    of vectors has one width). A width that ``parts`` doesn't divide gives parts
    that differ by one; parts without components have code 00. Integer
    components beyond ``LIMIT`` count as ``LIMIT``. Rows may repeat, ids too;
    null labels are one label. An empty table gives an empty one and no codebooks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    books = fit_codebooks(vectors, id_col, vector_col, parts, entries, rounds)
    own = F.col("label") if label is None else label
    key = F.coalesce(F.concat(F.lit("l"), own.cast("string")), F.lit(""))
    named = vectors.withColumn(f"{OWN}label", key)
    coded, _ = materialize_measured(encode_vectors(named, books, vector_col).drop("label_error"), "vector-codes")
    sums = coded.groupBy(f"{OWN}label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    return coded.join(sums, f"{OWN}label").drop(f"{OWN}label"), books
