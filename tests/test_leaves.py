"""The search over leaves: against all pairs, on odd layouts, and without the package on the executors."""

import math
import os
import random
import subprocess
import sys
import time

import pytest
from conftest import brute, rows

import geonear as g
from geonear.operators import leaves as lv
from geonear.operators.knn import _neighbours


@pytest.fixture(params=["in place", "by leaf"])
def way(request, monkeypatch):
    """Both ways of the search: all destinations sent, or groups of origins and leaves."""
    if request.param == "by leaf":
        monkeypatch.setattr(lv, "BROADCAST_KEYS", -1)
        monkeypatch.setattr(lv, "GROUP_ROWS", 7)
    return request.param


def points(seed, n, spread=1000.0):
    rng = random.Random(seed)
    centres = [(rng.uniform(0, spread), rng.uniform(0, spread)) for _ in range(4)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3:  # a lattice, for ties
            out.append((float(rng.randrange(0, 1000, 100)), float(rng.randrange(0, 1000, 100))))
        elif kind < 0.6:
            cx, cy = rng.choice(centres)
            out.append((cx + rng.gauss(0, 1), cy + rng.gauss(0, 1)))
        else:
            out.append((rng.uniform(0, spread), rng.uniform(0, spread)))
    return out


@pytest.mark.parametrize("k,cap,leaf_keys", [(1, None, 2), (1, 60.0, 5), (4, None, 8), (30, 150.0, 40), (500, None, 20)])
def test_search_equals_all_pairs(spark, make, way, k, cap, leaf_keys):
    origins = [(i, x, y) for i, (x, y) in enumerate(points(1, 60))]
    origins += [(3, 5000.0, -700.0), (3, 10.0, 10.0), (900, None, 1.0), (901, float("nan"), 1.0), (902, float("inf"), 1.0)]
    destinations = [(f"d{i % 90:03}", x, y) for i, (x, y) in enumerate(points(2, 200))]
    destinations += [("x", None, 1.0), ("y", 1.0, float("nan"))]
    found = g.build_leaves(make(destinations, "destination"), k, leaf_keys)
    answer = _neighbours(lv.search_leaves(make(origins, "origin"), found, cap).where("size(nearest) > 0"))
    known = [o for o in origins if o[1] is not None and abs(o[1]) < float("inf")]
    assert rows(answer) == brute(known, [d for d in destinations if d[1] is not None and d[2] == d[2]], k, cap)


def test_ties_and_unmatched_origins(spark, make, way):
    origins = [(1, 0.0, 0.0), (2, 5.0, 5.0), (3, 900.0, 0.0), (None, 0.0, 0.0)]
    destinations = [("a", 3.0, 4.0), ("b", 4.0, 3.0), ("c", 4.0, 3.0), ("d", -5.0, 0.0), ("e", 5.0, 6.0)]
    a, b = make(origins, "origin"), make(destinations, "destination")
    tied = sorted((str(o), d) for o, d, _ in map(tuple, g.nearest_all_ties(a, b, 100.0).collect()))
    assert tied == [*[("1", d) for d in "abcd"], ("2", "e"), *[("None", d) for d in "abcd"]]
    assert {(str(r.origin), r.destination) for r in g.nearest(a, b, 100.0, how="left").collect()} == {
        ("1", "a"), ("2", "e"), ("3", None), ("None", "a")}
    assert g.nearest(a, b, 100.0).count() == 3
    with pytest.raises(Exception, match="no destination for origin 3"):
        g.nearest(a, b, 100.0, how="error").collect()
    assert g.nearest(a.where("origin = 1"), b, 100.0, how="error").count() == 1
    assert g.nearest(a, b.limit(0), 100.0).count() == 0 and g.nearest(a, b.limit(0), how="left").count() == 4


def test_the_forms_agree_with_tiles(spark, make, way):
    a = make([(i, x, y) for i, (x, y) in enumerate(points(5, 40))], "origin")
    b = make([(f"d{i}", x, y) for i, (x, y) in enumerate(points(6, 80))], "destination")
    tiles = g.build_tiles(b, a, 5)
    assert rows(g.knn_join(a, b, 5)) == rows(g.knn_join(a, b, 5, tiles=tiles))
    assert rows(g.knn_join_top1(a, b, 5)) == rows(g.knn_join_top1(a, b, 5, tiles=tiles)) == rows(g.nearest(a, b))
    capped, free = g.build_tiles(b, a, 1, 120.0), g.build_tiles(b, a)
    for form in (g.nearest_by_window, g.nearest_distinct_on, g.nearest_sort_dedupe):
        assert rows(form(a, b, 120.0)) == rows(form(a, b, 120.0, tiles=capped))
    assert rows(g.nearest_all_vs_all(a, b)) == rows(g.nearest_all_vs_all(a, b, tiles=free)) == rows(g.nearest(a, b))
    assert rows(g.knn_rounded_first(a, b, 5, 0)) == rows(g.knn_rounded_first(a, b, 5, 0, tiles=tiles))


def test_a_tight_cluster_makes_no_long_lists(spark, make, way, monkeypatch):
    monkeypatch.setattr(lv, "GROUP_ROWS", 50_000)
    rng = random.Random(3)
    cluster = spark.range(20_000).selectExpr(
        "concat('d', lpad(id, 6, '0')) as destination", "5000 + 1e-5 * rand(1) as x", "5000 + 1e-5 * rand(2) as y")
    b = cluster.unionByName(make([("far", 90_000.0, 0.0)], "destination"))
    a = make([(i, rng.uniform(0, 1e5), rng.uniform(0, 1e5)) for i in range(2000)], "origin")
    found = g.build_leaves(b, 1)
    assert int(found.index["n"].max()) <= 2 * 1024
    start = time.monotonic()
    answer = {r.origin: (r.destination, r.distance) for r in _neighbours(lv.search_leaves(a, found)).collect()}
    assert time.monotonic() - start < 30
    placed = [(r.destination, r.x, r.y) for r in b.collect()]
    for o, x, y in [tuple(r) for r in a.collect()][:20]:
        assert answer[o] == min((math.sqrt((x - p) * (x - p) + (y - q) * (y - q)), d) for d, p, q in placed)[::-1]


def test_plans_shuffle_no_pairs(spark, make):
    a = make([(i, x, y) for i, (x, y) in enumerate(points(7, 40))], "origin")
    b = make([(f"d{i}", x, y) for i, (x, y) in enumerate(points(8, 80))], "destination")
    plan = g.knn_join(a, b, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "Window" not in plan


def test_executors_need_no_package(tmp_path):
    # The driver finds the package by sys.path; workers start elsewhere, without it.
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import geonear as g
from geonear.operators import leaves as lv
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").getOrCreate()
a = spark.range(50).selectExpr("id as origin", "id * 7.0D as x", "id * 3.0D as y")
b = spark.range(30).selectExpr("concat('d', id) as destination", "id * 11.0D as x", "id * 5.0D as y")
tiles = g.build_tiles(b, a, 2, 100.0)
counts = [g.knn_join(a, b, 2, 100.0, tiles=tiles).count(), g.knn_join(a, b, 2, 100.0).count(),
          g.nearest_in_square(a, b, 100.0).count()]
lv.BROADCAST_KEYS = -1
counts.append(g.knn_join(a, b, 2, 100.0).count())
print("counts", counts)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    said = [line for line in done.stdout.splitlines() if line.startswith("counts")]
    assert said, done.stderr[-2000:]
    first, second, _, third = eval(said[0].split(" ", 1)[1])
    assert first == second == third > 0
