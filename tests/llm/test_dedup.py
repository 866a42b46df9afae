"""Exact, line and SimHash dedup against plain Python."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from geonear.llm import exactdedup, linededup, simhash
from geonear.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def docs(spark, texts, sources=None):
    return table(spark, [(i, t, None, sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)])


# --- exact ------------------------------------------------------------------------


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm):
        group = [rows[j][0] for j, m in enumerate(norm) if m == n]
        known = [g for g in group if g is not None]
        keep = min(known) if known else None
        out.append((i, keep, len(group), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


EXACT = [(3, "a  b"), (1, "a\t\nb"), (2, "a b "), (5, None), (4, ""), (None, "x"), (7, "x"), (7, "x"),
         (None, "only"), (9, "é" * 50_000), (8, "é" * 50_000), (10, "a b")]


@pytest.mark.parametrize("content_hash", [F.md5, lambda c: F.lit("same")])
def test_exact_dedup(spark, content_hash):
    got = exactdedup.exact_dedup(table(spark, EXACT, "doc_id long, text string"), content_hash=content_hash)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_exact(EXACT)


def test_exact_dedup_empty_and_clashing_names(spark):
    assert exactdedup.exact_dedup(table(spark, [], "doc_id long, text string")).count() == 0
    odd = table(spark, [(1, "t", "h", "n")], "doc_id long, text string, h string, norm string")
    assert exactdedup.exact_dedup(odd).first()["keep_id"] == 1


# --- lines --------------------------------------------------------------------------


def brute_lines(rows, max_ratio, min_pages):
    strip = lambda l: l.strip(" \t\n\r\x0b\x0c")
    out = []
    for text, host in rows:
        if text is None:
            out.append((None, 0, 0))
            continue
        site = [t for t, h in rows if h == host]
        lines = text.split("\n")
        drop = set()
        for i, l in enumerate(lines):
            n = sum(strip(l) in {strip(x) for x in (t or "").split("\n")} and t is not None for t in site)
            if strip(l) and n >= min_pages and n / len(site) > max_ratio:
                drop.add(i)
        out.append(("\n".join(l for i, l in enumerate(lines) if i not in drop), len(lines), len(drop)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    rng = random.Random(1)
    pool = ["home", " home ", "about", "", "x", "unique %d", " home"]
    rows = []
    for i in range(120):
        host = rng.choice(["a", "b", "", None])
        text = None if i % 30 == 0 else "\n".join(
            (p % i if "%" in p else p) for p in rng.choices(pool, k=rng.randint(0, 6)))
        rows.append((text, host))
    rows += [rows[5]] * 3 + [("", "a"), ("\n".join(["home"] * 3000), "b")]
    df = table(spark, [(i, t, None, h, len(t or "")) for i, (t, h) in enumerate(rows)])
    got = linededup.line_dedup(df, max_ratio=0.2, min_pages=5)
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    found = sorted(((r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=repr)
    assert found == brute_lines(rows, 0.2, 5)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.collect())


def test_line_dedup_empty_and_repeated_ids(spark):
    assert linededup.line_dedup(table(spark, [], DOCS)).count() == 0
    same = table(spark, [(None if i % 2 else 1, f"menu\n{i % 4}", None, "s", 0) for i in range(12)])
    got = linededup.line_dedup(same, max_ratio=0.5, min_pages=5).collect()
    assert sorted(r["text"] for r in got) == sorted(str(i % 4) for i in range(12))


def test_line_dedup_stays_in_the_jvm(spark):
    plan = linededup.line_dedup(docs(spark, ["a"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- simhash ----------------------------------------------------------------------------


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_fingerprints_match_spark_and_plain_python(spark):
    texts = ["", " \n ", "One", "one TWO", "É a B c", "a b c d e " * 40, "x " * 20_000, None, " a b c d"]
    got = simhash.with_fingerprint(docs(spark, texts)).collect()
    assert [r["fp"] % (1 << 64) for r in sorted(got, key=lambda r: r["doc_id"])] == [brute_fingerprint(t) for t in texts]
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % (1 << 64) == xxhash.xxh64(
        b"a b c", seed=42).intdigest()


@pytest.mark.parametrize("pair_bucket", [1, 32])
def test_links_reach_what_all_pairs_reach(spark, pair_bucket):
    rng = random.Random(4)
    fps = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(30):  # chains and clusters around random centres
        fp = rng.getrandbits(64)
        for _ in range(12):
            fps.add(fp)
            fp ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])))
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = connected_components(simhash.close_links(df, pair_bucket=pair_bucket))
    want = brute_components(signed, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2)
    linked = {n: r for n, r in want.items() if list(want.values()).count(r) > 1}
    assert {r["node"]: r["root"] for r in got.collect()} == linked


def varied(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


def test_simhash_groups_and_near_dedup(spark):
    rng = random.Random(5)
    base = [f"v{rng.randrange(10**6)}" for _ in range(2000)]
    rows = [(50 + i, varied(rng, base, 1)) for i in range(20)] + [(9, " ".join(base))] * 2
    rows += [(i, varied(rng, base, 2000)) for i in range(100, 110)]
    rows += [(4, None), (3, ""), (None, "lone words here"), (None, " ".join(base)), (None, "lone words here")]
    df = table(spark, [(i, t, "l", "s", 0, "x", 1) for i, t in rows], DOCS + ", fp string, root int")
    fps = {i: brute_fingerprint(t) for i, (_, t) in enumerate(rows)}
    group = brute_components(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[group[fps[i]]] = min(doc, least.get(group[fps[i]], doc))
    want = sorted(((d, f"{fps[i]:016x}", least.get(group[fps[i]])) for i, (d, _) in enumerate(rows)), key=repr)
    assert sorted(map(tuple, simhash.simhash_groups(df).collect()), key=repr) == want
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert len(ids) == len(set(group.values()))
    assert ids == sorted([least.get(g) for g in set(group.values())], key=repr)


def test_simhash_empty_table(spark):
    assert simhash.simhash_groups(table(spark, [], DOCS)).count() == 0
    assert simhash.near_dedup(table(spark, [], DOCS)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b").union(spark.range(3).selectExpr("id as a", "id as b"))
    got = connected_components(edges).collect()
    assert {r["node"] for r in got} == set(range(201)) and {r["root"] for r in got} == {0} and len(got) == 201
