"""Nearest vectors, packing and the whole pipeline against brute force."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geonear.llm import annpartition, packing, queries

SF_DIR = "/root/testdata/sf0.001"


def brute_nearest(rows, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
          if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if i % 20 == 0:
            scores = [(-float(v @ w), j) for j, w in ok if j != i]
            out[i] = sorted(scores)[:k]
    return out


def test_nearest_vectors(spark, monkeypatch):
    monkeypatch.setattr(annpartition, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.3 * rng.normal(size=8)).tolist()) for i in range(3000)]
    rows += [(i, [1.0] * 8) for i in range(3000, 4000)]  # one very common vector
    rows += [(5000, None), (5020, [0.0] * 8), (5040, [float("nan")] + [1.0] * 7), (5060, [None] + [1.0] * 7),
             (5080, [1.0] * 3), (5100, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, part int")
    got = annpartition.nearest_vectors(df, F.col("vec_id") % 20 == 0, sample_rows=1500).collect()
    want, found, hits = brute_nearest(rows, 20), {}, 0
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r)
    assert set(found) == set(want)
    for q, rs in found.items():
        assert [r["rank"] for r in rs] == list(range(1, 21)) and len({r["vec_id"] for r in rs}) == 20
        assert all(a["score"] > b["score"] or a["score"] == b["score"] and a["vec_id"] < b["vec_id"]
                   for a, b in zip(rs, rs[1:]))
        hits += len({r["vec_id"] for r in rs} & {j for _, j in want[q]})
    assert hits >= 0.9 * 20 * len(want)
    assert [r["vec_id"] for r in found[3000]] == list(range(3001, 3021))


def test_nearest_vectors_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    q = F.col("vec_id") % 20 == 0
    assert annpartition.nearest_vectors(spark.createDataFrame([], schema), q).count() == 0
    assert annpartition.nearest_vectors(spark.createDataFrame([(0, [1.0])], schema), q).count() == 0
    two = annpartition.nearest_vectors(spark.createDataFrame([(0, [2.0]), (1, [3.0]), (2, None)], schema), q)
    assert [tuple(r) for r in two.collect()] == [(0, 1, 1, 6.0)]
    exact = annpartition.nearest_vectors(
        spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.1, 7.0])], "vec_id long, embedding array<double>"), q)
    assert [r["score"] for r in exact.collect()] == [0.1]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    m = df.orderBy("vec_id").toPandas()
    x, ids = np.array(m["embedding"].tolist(), float), m["vec_id"].to_numpy()
    got = queries.op2_learned_partitions(spark, "/root/testdata/sf0.1").toPandas().groupby("query_id")["vec_id"].apply(set)
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[ids[q]] & set(ids[np.argsort(-s, kind="stable")[:20]]))
    assert hits >= 0.9 * 20 * len(got)


def test_balanced_parts():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 6))
    label = annpartition.balanced_partition(x, annpartition.neighbour_graph(x, 8), 10, rng)
    assert np.bincount(label, minlength=10).max() <= 88


# --- packing --------------------------------------------------------------------------------


def padding(lengths, counts, ends):
    return sum(n * (min(e for e in ends if e >= l) - l) for l, n in zip(lengths, counts))


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        lengths = sorted(rng.sample(range(60), rng.randint(1, 8)))
        counts = [rng.randint(1, 9) for _ in lengths]
        k = rng.randint(1, 4)
        ends = packing.optimal_boundaries(lengths, counts, k)
        best = min(padding(lengths, counts, [*c, lengths[-1]])
                   for n in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], n))
        assert padding(lengths, counts, ends) == best and len(ends) <= k and ends == sorted(set(ends))
    assert packing.optimal_boundaries([], [], 4) == []


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([1, 2, 3, 10, 11, 40]))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, " \n "), (403, "w " * 5000), (None, "a b"), (7, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, bucket string")
    got = packing.pack(df, max_tokens=64, n_buckets=3, token_budget=200, shard_rows=90).collect()
    words = {}
    for i, t in rows:
        words.setdefault(i, []).append(len((t or "").split()))
    totals, pieces = {}, {}
    for r in got:
        assert 0 <= r["n_tokens"] <= r["bucket_tokens"] <= 64 and r["padding"] == r["bucket_tokens"] - r["n_tokens"]
        assert r["offset"] == 64 * r["piece"]
        totals[r["doc_id"]] = totals.get(r["doc_id"], 0) + r["n_tokens"]
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + 1
    assert totals == {i: sum(w) for i, w in words.items()}
    assert pieces == {i: sum(max(1, -(-n // 64)) for n in w) for i, w in words.items()}
    batches = {}
    for r in got:
        batches.setdefault(r["batch_id"], []).append(r)
    for rs in batches.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs))) and len({r["bucket"] for r in rs}) == 1
        assert len(rs) == 1 or len(rs) * max(rs[0]["bucket_tokens"], 1) <= 200
    lengths = sorted({r["n_tokens"] for r in got})
    counts = [sum(r["n_tokens"] == l for r in got) for l in lengths]
    best = min(padding(lengths, counts, [*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1], 2))
    assert sum(r["padding"] for r in got) == best
    assert packing.pack(df.limit(0)).count() == 0


# --- pipeline -----------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").cache()
    columns, now, kept = docs.columns, docs, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF_DIR).cache()
        assert out.columns == columns and out.dtypes == docs.dtypes
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids))
        now = out
        kept = set(ids)
    places = corpus_pipeline.run(spark, SF_DIR)
    assert {r["doc_id"] for r in places.select("doc_id").collect()} == kept
    assert not any("@mail" in r["text"] for r in now.collect())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
