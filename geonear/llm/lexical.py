"""Ranked lexical search over blocks of posting lists, with exact bounds."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geonear.llm.common import texts_of
from geonear.session import materialize_measured

K = 10
#: Different terms of the queries that are searched for in one pass over the documents.
QUERY_TERMS = 8192
#: Queries of one pass.
QUERY_ITEMS = 4096
#: Documents of one index shard, at most, and cells (documents by terms) of its table.
SHARD_DOCS = 4096
SHARD_CELLS = 1 << 24
#: Postings of a block, on average; a list of at most that many is one block.
BLOCK_POSTINGS = 64
SKETCH = 16  # dimensions in which documents are compared for clustering
SEED = 11

# Bytes of a term (digits, letters and all of non-ASCII) with A-Z
# lower-cased; every other byte parts terms.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256))


def terms_of(text: str) -> list[bytes]:
    """Terms in order, repeats included: maximal runs of letters, digits and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class QueryBlock:
    """Queries searched together: ``items`` (row, id) and their terms with repeats."""

    items: list = field(default_factory=list)
    counts: list[Counter] = field(default_factory=list)
    vocabulary: dict[bytes, int] = field(default_factory=dict)

    def takes(self, found: Counter) -> bool:
        if not self.items:
            return True
        new = sum(t not in self.vocabulary for t in found)
        return len(self.items) < QUERY_ITEMS and len(self.vocabulary) + new <= QUERY_TERMS

    def add(self, item, found: Counter) -> None:
        self.items.append(item)
        self.counts.append(found)
        for t in found:
            self.vocabulary.setdefault(t, len(self.vocabulary))


def query_blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[QueryBlock]:
    """The queries in blocks of bounded size, which the driver holds one at a time.

    A query with more than ``QUERY_TERMS`` terms makes a block of its own.
    """
    block = QueryBlock()
    for row in items.select(item_col, text_col).toLocalIterator():
        found = Counter(terms_of(row[1] or ""))
        if not found:
            continue
        if not block.takes(found):
            yield block
            block = QueryBlock()
        block.add(row[0], found)
    if block.items:
        yield block


def term_vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, n, terms, tfs``: per document its number of terms, and how often it has those of a vocabulary."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms, tfs, ends = [], [], [], [0]
            for text in texts_of(batch, text_col):
                found = terms_of(text)
                sizes.append(len(found))
                for t, n in Counter(found).items():
                    at = vocabulary.get(t)
                    if at is not None:
                        terms.append(at)
                        tfs.append(n)
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.record_batch([
                batch.column(id_col).cast(pa.int64()), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(id_col, text_col).mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>")


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term's weight is multiplied by, from its occurrences and the document's length."""
    exact = n if len(n) == 0 or 75 * int(n.max()) * n_docs < 1 << 63 else n.astype(object)
    m = 25 + (75 * exact * n_docs) // n_terms
    return ((1_000_000_000 * tf) // (1000 * tf + 8 * m)).astype(np.int64)


class Searcher:
    """The best documents of each query so far; takes documents a shard at a time.

    In a shard each posting list is clustered by the similarity of whole
    documents into blocks, and every block has the maximum of each coordinate
    over its documents. Lists are taken from heavy terms to light ones, which
    brings high scores first. A document that has a heavier term of the query
    as well was met in that list already, and either scored or found unable to
    reach the k-th score so far; so the product of the summary with the query's
    terms from this one on bounds the score of all others in the block. A block
    is skipped if this bound is below the query's k-th score so far, and for no
    other reason; a whole list likewise, by the maxima of the shard. Scores
    reached in one shard serve the next.
    """

    def __init__(self, queries: list[dict[int, int]], weights: np.ndarray, k: int):
        self.k = k
        self.weights = weights
        self.terms = [np.array(sorted(q), np.int64) for q in queries]
        self.worth = [np.array([q[t] for t in ts.tolist()], np.int64) * weights[ts] for q, ts in zip(queries, self.terms)]
        highest = max((int(w.sum()) for w in self.worth), default=0) * 1_000_000
        self.number = np.float64 if highest < 1 << 53 else np.int64  # sums are exact in either
        asked: dict[int, list[int]] = {}
        for j, ts in enumerate(self.terms):
            for t in ts.tolist():
                asked.setdefault(t, []).append(j)
        heavy_first = np.lexsort((np.arange(len(weights)), -weights))
        place = np.argsort(heavy_first)
        self.lists = []
        for t in heavy_first.tolist():
            if t in asked and weights[t] > 0:
                left = [place[self.terms[j]] >= place[t] for j in asked[t]]
                axes = np.unique(np.concatenate([self.terms[j][l] for j, l in zip(asked[t], left)]))
                worth = np.zeros((len(axes), len(asked[t])), self.number)
                for i, (j, l) in enumerate(zip(asked[t], left)):
                    worth[np.searchsorted(axes, self.terms[j][l]), i] = self.worth[j][l]
                self.lists.append((t, np.array(asked[t]), axes, worth))
        self.score = [np.zeros(0, np.int64) for _ in queries]
        self.found = [np.zeros((2, 0), np.int64) for _ in queries]  # null or not, id
        self.floor = np.zeros(len(queries), np.int64)  # k-th score so far
        self.blocks = self.opened = 0
        rng = np.random.default_rng(SEED)
        self.axes = rng.standard_normal((len(weights), SKETCH)).astype(np.float32)

    def add(self, ids: np.ndarray, nulls: np.ndarray, table: np.ndarray) -> None:
        """Search a shard: documents by terms, ``table`` holding the impacts."""
        sketch = (table * self.weights.astype(np.float32)) @ self.axes
        sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-30)
        highest = table.max(axis=0, initial=0)
        met = np.zeros((len(self.terms), len(table)), bool)
        for t, asked, axes, worth in self.lists:
            able = np.flatnonzero(highest[axes] @ worth >= self.floor[asked]) if highest[t] else ()
            if not len(able):
                continue
            rows, starts = self._blocks(np.flatnonzero(table[:, t]), sketch)
            summary = np.maximum.reduceat(table[rows[:, None], axes], starts, axis=0)
            bounds = summary.astype(self.number) @ worth[:, able]
            opened = bounds >= self.floor[asked[able]]
            self.blocks += bounds.size
            self.opened += int(opened.sum())
            sizes = np.diff(np.r_[starts, len(rows)])
            for i in np.flatnonzero(opened.any(axis=0)).tolist():
                j = int(asked[able[i]])
                inside = rows if opened[:, i].all() else rows[np.repeat(opened[:, i], sizes)]
                inside = inside[~met[j, inside]]
                if len(inside):
                    met[j, inside] = True
                    self._rank(j, ids[inside], nulls[inside], self._scores(table[inside[:, None], self.terms[j]], j))

    @staticmethod
    def _blocks(rows: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A posting list in the order of its clusters, and where each begins."""
        if len(rows) <= BLOCK_POSTINGS:
            return rows, np.zeros(1, np.int64)
        centres = rows[:: BLOCK_POSTINGS]
        label = np.argmax(sketch[rows] @ sketch[centres].T, axis=1)
        order = np.argsort(label, kind="stable")
        label = label[order]
        return rows[order], np.flatnonzero(np.r_[True, label[1:] != label[:-1]])

    def _scores(self, impacts_: np.ndarray, j: int) -> np.ndarray:
        return (impacts_.astype(self.number) @ self.worth[j].astype(self.number)).astype(np.int64)

    def _rank(self, j: int, ids: np.ndarray, nulls: np.ndarray, scores: np.ndarray) -> None:
        good = (scores > 0) & (scores >= self.floor[j])
        score = np.r_[self.score[j], scores[good]]
        found = np.c_[self.found[j], np.stack([nulls[good], ids[good]])]
        first = np.lexsort((found[1], found[0], -score))[: self.k]
        self.score[j], self.found[j] = score[first], found[:, first]
        if len(first) == self.k:
            self.floor[j] = self.score[j][-1]


def _search_udf(queries: list[dict[int, int]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    width = len(weights)
    most = max(1, min(SHARD_DOCS, SHARD_CELLS // max(width, 1)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(queries, weights, k)
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            ids = rows.column("doc_id")
            terms, tfs = rows.column("terms"), rows.column("tfs")
            sizes = np.diff(terms.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            table = np.zeros((len(sizes), width), np.int32)
            table[row, terms.flatten().to_numpy()] = impacts(
                tfs.flatten().to_numpy(), rows.column("n").to_numpy()[row], n_docs, n_terms)
            searcher.add(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), table)
            held.clear()

        n = 0
        for batch in batches:
            while len(batch):
                part = batch.slice(0, most - n)
                held.append(part)
                n += len(part)
                batch = batch.slice(len(part))
                if n == most:
                    flush()
                    n = 0
        if n:
            flush()
        sizes = [len(s) for s in searcher.score]
        null, ids = np.concatenate([np.zeros((2, 0), np.int64), *searcher.found], axis=1)
        yield pa.record_batch([
            pa.array(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)),
            pa.array(ids, mask=null.astype(bool)), pa.array(np.concatenate([np.zeros(0, np.int64), *searcher.score]))],
            names=["query", "doc_id", "score"])

    return search


def lexical_search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` highest-scoring documents of every item: ``item_id, rank, doc_id, score``.

    Scores are those of the contract: integer weights of terms times integer
    impacts of their occurrences, for documents of any length. Equal scores go
    by ascending id, null ids last; rows of one id are ranked each. Items
    without terms, or whose terms no document has, have no rows; neither has a
    document with score 0. Item rows that repeat an id are ranked each. Ids of
    documents are integers. Empty tables on either side give an empty one.

    Two jobs per block of queries: the first counts terms and stores, for each
    document, its few numbers for the queries' terms; statistics cover all
    documents. The second searches that table a shard at a time
    (:class:`Searcher`), and Spark ranks what the tasks found: ``k`` rows per
    task and query.
    """
    spark = docs.sparkSession
    item_type = items.schema[item_col].dataType.simpleString()
    results = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    for block in query_blocks(items, item_col, item_text):
        counted = term_vectors(docs, block.vocabulary, id_col, text_col)
        vectors, seen = _stored(counted)
        if not seen["n_docs"]:
            continue
        df = dict(vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = np.array([term_weight(seen["n_docs"], df.get(t, 0)) for t in range(len(block.vocabulary))], np.int64)
        queries = [{block.vocabulary[t]: n for t, n in c.items()} for c in block.counts]
        found = vectors.mapInArrow(
            _search_udf(queries, weights, seen["n_docs"], seen["n_terms"], k), "query int, doc_id long, score long")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.items)), f"query int, item_id {item_type}")
        results = results.unionByName(ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return results


def _stored(counted: DataFrame) -> tuple[DataFrame, dict]:
    """The vectors that hold a query's term, with the statistics of all documents."""
    from pyspark.sql import Observation

    from geonear.session import scratch_path

    spark, seen = counted.sparkSession, Observation()
    path = scratch_path(spark, "term-vectors")
    counted.observe(seen, F.count_if(F.col("n") > 0).alias("n_docs"), F.sum("n").alias("n_terms")).where(
        F.size("terms") > 0).write.parquet(path)
    return spark.read.schema(counted.schema).parquet(path), seen.get
