"""Lexical search, source mixing and vector codes against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from geonear.llm import lexical, mixing, vectorcodes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def make_docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, len(t or "")) for i, t, s in rows], DOCS)


# --- lexical search ---------------------------------------------------------------


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=10):
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in counted)
    n_terms = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms if n_terms else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in plain_terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i, score))
        out += [(item, rank, s[3], s[4]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=str)


def random_texts(n, seed, vocabulary=60, longest=40):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(vocabulary)]
    return [" ".join(rng.choice(pool[: rng.choice((6, vocabulary))]) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("block,shard", [(64, 4096), (2, 7)])
def test_search_equals_all_scores(spark, monkeypatch, block, shard):
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", block)
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    docs = list(enumerate(random_texts(150, 1)))
    docs += [(500 + i, t) for i, t in docs[:20]] + [(500, docs[3][1]), (None, docs[3][1]), (600, None), (601, ""), (602, "!?")]
    items = list(enumerate(random_texts(12, 2, longest=15))) + [(90, None), (91, "zzzz"), (5, docs[3][1]), (92, docs[3][1])]
    found = lexical.lexical_search(
        make_docs(spark, [(i, t, "s") for i, t in docs]), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=str) == plain_search(docs, items)


def test_search_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_TERMS", 10)
    docs, items = list(enumerate(random_texts(60, 3))), list(enumerate(random_texts(8, 4)))
    found = lexical.lexical_search(
        make_docs(spark, [(i, t, "s") for i, t in docs]), spark.createDataFrame(items, "item_id long, text string"), k=3)
    assert sorted(map(tuple, found.collect()), key=str) == plain_search(docs, items, 3)


def test_search_of_empty_tables_and_long_texts(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    some = spark.createDataFrame([("x", "lone word")], "item_id string, text string")
    docs = make_docs(spark, [(1, "word " * 300_000 + "lone", "s"), (2, "word other", "s"), (3, "third", "s")])
    assert lexical.lexical_search(docs, none).collect() == []
    assert lexical.lexical_search(docs.limit(0), some).collect() == []
    plain = plain_search([(r.doc_id, r.text) for r in docs.collect()], [("x", "lone word")])
    assert sorted(map(tuple, lexical.lexical_search(docs, some).collect()), key=str) == plain


def test_other_names_and_extra_columns(spark):
    docs = make_docs(spark, [(1, "a b", "s"), (2, "b c", "s"), (3, "d", "s")]).selectExpr(
        "cast(doc_id as int) as key", "text as body", "1 as score", "2 as rank", "3 as terms", "4 as n")
    items = spark.createDataFrame([("q", "c", 7)], "name string, words string, score int")
    found = lexical.lexical_search(docs, items, id_col="key", text_col="body", item_col="name", item_text="words")
    assert [tuple(r)[:3] for r in found.collect()] == [("q", 1, 2)]


def test_blocks_are_skipped_by_their_bounds():
    rng = np.random.default_rng(5)
    terms = 40
    # Two kinds of documents with terms of their own, and one good answer of the first kind.
    table = np.zeros((2000, terms), np.int32)
    for d in range(2000):
        low = 0 if d % 2 else 20
        table[d, low + rng.choice(20, 6, replace=False)] = rng.integers(1000, 30_000, 6)
    table[7, :10] = 900_000
    # In the second shard the maxima of all documents promise as much, but no document with term 0 does.
    table[1500, 0] = table[1501, 1:10] = 900_000
    weights = np.array([900 - t for t in range(terms)], np.int64)
    searcher = lexical.Searcher([{t: 1 for t in range(10)}], weights, 1)
    for at in (0, 1000):
        part = table[at:at + 1000]
        searcher.add(np.arange(at, at + len(part)), np.zeros(len(part), np.int64), part)
    assert searcher.found[0][1].tolist() == [7]
    assert searcher.opened < searcher.blocks
    scores = (table[:, :10].astype(np.int64) * weights[:10]).sum(axis=1)
    assert searcher.score[0][0] == scores.max()


# --- mixing -----------------------------------------------------------------------


def make_corpus(spark, n=1500):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        source = "big" if i % 3 == 0 else rng.choice(["a", "b", "ç", "z", None])
        size = rng.choice((0, 1, 5, 30, 60)) if i % 50 else 900
        rows.append((i, " ".join(rng.choice("abcdefghij") for _ in range(size)), source))
    return rows


def plain_targets(rows, weights=(3, 1, 2), share=1.5, most=2):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped = set()
    while True:
        free = [s for s in order if s not in capped]
        left = share * sum(sizes.values()) - most * sum(sizes[s] for s in capped)
        rate = left / sum(w[s] for s in free) if free else 0.0
        over = {s for s in free if w[s] * rate > most * sizes[s]}
        if not over:
            return sizes, {s: most * sizes[s] if s in capped else w[s] * rate for s in order}
        capped |= over


@pytest.mark.parametrize("window_rows", [20_000, 1])
def test_sources_meet_their_targets(spark, window_rows):
    rows = make_corpus(spark)
    mixed = mixing.mix_sources(make_docs(spark, rows), window_rows=window_rows).collect()
    sizes, targets = plain_targets(rows)
    assert sorted(r.doc_id for r in mixed) == list(range(len(rows)))
    taken, longest = Counter(), Counter()
    for r in mixed:
        assert r.size == len(rows[r.doc_id][1].split()) and r.taken == r.copies * r.size and 0 <= r.copies <= 2
        assert r.source_size == sizes[r.source] and math.isclose(r.target, targets[r.source], rel_tol=1e-12)
        if r.size:
            assert r.copies >= int(r.target / r.source_size)
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    for s, t in targets.items():
        assert abs(taken[s] - t) <= longest[s] / 2 + 1e-6
    again = mixing.mix_sources(make_docs(spark, rows).repartition(5)).collect()
    assert sorted((r.doc_id, r.copies) for r in mixed) == sorted((r.doc_id, r.copies) for r in again)


def test_the_order_follows_odds(spark):
    # One source, half of whose documents are preferred: they get the further copies more often.
    rows = [(i, "a b c d e f g h" if i % 2 else "a a a a a a a a", "s") for i in range(4000)]
    mixed = mixing.mix_sources(make_docs(spark, rows), share=1.25).collect()
    more = Counter((r.doc_id % 2, r.copies) for r in mixed)
    share = {kind: more[kind, 2] / 2000 for kind in (0, 1)}
    want = {r.doc_id % 2: r.inclusion for r in mixed}
    assert math.isclose(want[1] / want[0], 8.0) and math.isclose((want[0] + want[1]) / 2, 0.25)
    assert all(abs(share[kind] - want[kind]) < 0.03 for kind in share)


def test_repeated_rows_and_ids_are_cut_without_a_window_of_all(spark):
    rows = [(None, "one two three", "s")] * 600 + [(None, "other words", "s")] * 300 + [(7, "x y", None)] * 100
    mixed = mixing.mix_sources(make_docs(spark, rows), window_rows=1).collect()
    _, targets = plain_targets(rows)
    for s, t in targets.items():
        assert abs(sum(r.taken for r in mixed if r.source == s) - t) <= 1.5
    again = mixing.mix_sources(make_docs(spark, rows[::-1]), window_rows=1).collect()
    key = lambda r: (str(r.doc_id), r.text, str(r.source), r.copies)
    assert sorted(map(key, mixed)) == sorted(map(key, again))


def test_mix_of_odd_tables(spark):
    assert mixing.mix_sources(make_docs(spark, [])).collect() == []
    blank = mixing.mix_sources(make_docs(spark, [(1, None, "s"), (2, " \t", None)])).collect()
    assert [(r.size, r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 2
    docs = make_docs(spark, [(1, "a b", "s"), (2, "c", "s")]).selectExpr("*", "'x' as size", "5 as more", "'t' as target", "1 as n")
    out = mixing.mix_sources(docs)
    assert out.columns == [*(c for c in docs.columns if c not in mixing.ADDED), *mixing.ADDED]
    assert sum(r.taken for r in out.collect()) in (4, 5)
    assert mixing.expand_mix(out).count() == sum(r.copies for r in out.collect())


def test_mix_runs_no_python(spark):
    plan = mixing.mix_sources(make_docs(spark, make_corpus(spark, 50)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- vector codes -------------------------------------------------------------------


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(min(kept)[2])
    bounds = [width * p // parts for p in range(parts + 1)]
    books = [[v[a:b] for _, _, v in sorted(kept)[:entries]] for a, b in zip(bounds, bounds[1:])]

    def assign():
        out = []
        for _, _, v in kept:
            row = []
            for (a, b), book in zip(zip(bounds, bounds[1:]), books):
                d = [sum((x - y) ** 2 for x, y in zip(v[a:b], e)) for e in book]
                row.append((d.index(min(d)), min(d)))
            out.append(row)
        return out

    for _ in range(rounds):
        found = assign()
        for p, (a, b) in enumerate(zip(bounds, bounds[1:])):
            for e in range(len(books[p])):
                mine = [v[a:b] for (_, _, v), row in zip(kept, found) if row[p][0] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    coded = [(i, label, "".join(f"{e:02x}" for e, _ in row), sum(d for _, d in row)) for (i, label, _), row in zip(kept, assign())]
    errors = Counter()
    for _, label, _, e in coded:
        errors[label] += e
    text = ",".join(str(x) for book in books for e in book for x in e)
    return sorted(((i, c, e, errors[label]) for i, label, c, e in coded), key=str), text


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")


def coded_rows(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in df.collect()), key=str)


@pytest.mark.parametrize("width,n", [(32, 200), (16, 40), (20, 90)])
def test_codes_equal_a_plain_computation(spark, width, n):
    rng = np.random.default_rng(width)
    # Coarse values, so that parts repeat and distances tie.
    rows = [(i, int(i % 3) if i % 4 else None, (rng.integers(-6, 7, width) / 4).tolist()) for i in range(n)]
    rows += [(1000, 1, None), (1001, 1, []), (1002, 1, [None] * width), (1003, 2, [float("nan")] * width),
             (1004, 2, [float("inf")] + [0.0] * (width - 1)), (1005, 0, rows[0][2]), (1005, 0, rows[1][2])]
    coded, books = vectorcodes.compress_vectors(vectors(spark, rows))
    want, text = plain_codes(rows)
    assert coded_rows(coded) == want and books.text() == text


def test_the_trie_equals_all_distances():
    rng = np.random.default_rng(2)
    for m, leaves in ((1, 4), (3, 4), (4, 50), (4, 10_000)):
        rows = np.unique(rng.integers(-9, 9, (700, m)), axis=0)
        entries = rng.integers(-9, 9, (20, m))
        d = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
        nearest, least = vectorcodes.trie_distances(rows, entries, leaves)
        assert (nearest == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()


def test_codes_of_odd_tables(spark):
    coded, books = vectorcodes.compress_vectors(vectors(spark, []))
    assert books is None and coded.collect() == [] and {"code", "error", "label_error"} <= set(coded.columns)
    # Another width than the first row's, huge numbers, one row alone, clashing names.
    rows = vectors(spark, [(3, 1, [1e30, -1e30] * 8), (4, 1, [1.0] * 8)]).selectExpr("*", "'x' as error", "1 as code", "2 as part")
    coded, books = vectorcodes.compress_vectors(rows)
    assert [(r.vec_id, r.code, r.error, r.part) for r in coded.collect()] == [(3, "00" * 16, 0, 2)]
    assert books.entries[0].tolist() == [[vectorcodes.LIMIT]] and books.entries[1].tolist() == [[-vectorcodes.LIMIT]]


def test_decoded_vectors_are_near(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 0, (rng.integers(0, 3, 32) / 2).tolist()) for i in range(50)]
    coded, books = vectorcodes.compress_vectors(vectors(spark, rows))
    for r in vectorcodes.decode_vectors(coded, books).collect():
        d = sum((math.floor(256 * a) - 256 * b) ** 2 for a, b in zip(r.embedding, r.decoded))
        assert d == r.error
