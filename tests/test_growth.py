"""Work and bytes that must not grow faster than the tables."""

import math
import random

import pytest
from conftest import brute, rows

import __spark_entry__ as contract
import geonear as g


def metric(df, node, name):
    """The largest value of a metric among the plan's nodes of a kind, and their sum."""
    def walk(plan):
        kind = plan.nodeName()
        if kind == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if "QueryStage" in kind:
            return walk(plan.plan())
        held = plan.metrics().get(name)
        own = [held.get().value()] if node in kind and held.isDefined() else []
        children = plan.children()
        return own + [v for i in range(children.size()) for v in walk(children.apply(i))]

    found = walk(df._jdf.queryExecution().executedPlan())
    return max(found, default=0), sum(found)


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    """1 000 origins among 3 000 destinations, as tables."""
    folder = tmp_path_factory.mktemp("dense")
    spark.range(1000).selectExpr("id * 7 as o_orderkey").write.parquet(f"{folder}/orders.parquet")
    spark.range(9000).selectExpr("id as c_custkey", "concat('C', id) as c_name").write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def test_hex_lateral_meets_cells_only_where_the_nearest_is_outside_the_disk(spark, dense):
    found = contract.udf_hex_lateral(spark, dense)
    assert rows(found) == rows(contract.knn_hex(spark, dense))
    found.collect()
    assert metric(found, "Join", "numOutputRows")[0] <= 2000


def test_sql_functions_rank_few_pairs_an_origin(spark, dense):
    found = contract.udf_sql_functions(spark, dense)
    assert rows(found) == rows(contract.knn_pyramid(spark, dense))
    found.collect()
    assert metric(found, "Join", "numOutputRows")[0] <= 8000


@pytest.fixture()
def few_places(make):
    """400 origins that are nearest to four places, whose keys are long."""
    rng = random.Random(3)
    a = [(i, float(rng.randrange(4) * 100), float(rng.randrange(3))) for i in range(400)]
    b = [(f"{j}" * 10_000, j * 100.0, 1.0) for j in range(4)]
    return a, b, make(a, "origin").repartition(5), make(b, "destination")


def test_ties_leave_together_by_place(few_places):
    a, b, origins, destinations = few_places
    found = g.nearest_all_ties(origins, destinations, 50.0)
    assert rows(found) == brute(a, b)
    keys = [r.destination[0] for r in found.collect()]
    assert sum(x != y for x, y in zip(keys, keys[1:])) <= 3


def test_first_of_ties_is_found_without_moving_keys(few_places):
    a, b, origins, destinations = few_places
    found = g.nearest_first_of_ties(origins, destinations, 50.0)
    assert rows(found) == brute(a, b)
    found.collect()
    assert metric(found, "Exchange", "dataSize")[1] < 1_000_000


def test_first_of_ties_with_repeated_origins_and_keys(make):
    a = [(1, 0.0, 0.0), (1, 10.0, 0.0), (None, 0.0, 0.0), (2, 5.0, 0.0), (3, 99.0, 0.0)]
    b = [("b", 0.0, 0.0), ("c", 0.0, 0.0), ("a", 10.0, 0.0), ("b", 10.0, 0.0)]
    found = g.nearest_first_of_ties(make(a, "origin"), make(b, "destination"), 20.0)
    assert {tuple(r) for r in found.collect()} == {(1, "a", 0.0), (None, "b", 0.0), (2, "a", 5.0)}


@pytest.mark.parametrize("keys", [0, 1_000_000])
def test_square_is_searched_over_leaves(make, monkeypatch, keys):
    monkeypatch.setattr("geonear.operators.leaves.BROADCAST_KEYS", keys)
    rng = random.Random(9)
    a = [(i, float(rng.randrange(60)), float(rng.randrange(60))) for i in range(200)] + [(900, 500.0, 0.0)]
    b = [(f"P{i:03}", float(rng.randrange(60)), float(rng.randrange(60))) for i in range(90)] + [("Q", 495.0, 5.0)]
    found = g.nearest_in_square(make(a, "origin"), make(b, "destination"), 5.0)
    assert rows(found) == brute(a, b, cap=5.0, square=True)
    if keys:
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("keys", [0, 1_000_000])
def test_first_of_many_neighbours_agrees_and_only_it_is_put_in_order(make, monkeypatch, keys):
    from geonear.functions import search
    from geonear.operators.leaves import build_leaves

    monkeypatch.setattr("geonear.operators.leaves.BROADCAST_KEYS", keys)
    rng = random.Random(8)
    a = [(i, float(rng.randrange(60)), float(rng.randrange(60))) for i in range(150)]
    b = [(f"P{i:03}", float(rng.randrange(60)), float(rng.randrange(60))) for i in range(400)]
    origins, destinations = make(a, "origin"), make(b, "destination")
    for cap in (None, 3.0):
        assert rows(g.knn_join_top1(origins, destinations, 20, cap)) == brute(a, b, cap=cap)
    if not keys:
        return
    leaves, sizes = build_leaves(destinations, 20, 40), []
    flat = leaves.whole.column("xs").combine_chunks()
    held = [len(v) for v in flat.to_pylist()]
    px, py = (leaves.whole.column(c).combine_chunks().flatten().to_numpy() for c in ("xs", "ys"))
    kept = search.first_k
    monkeypatch.setattr(search, "first_k", lambda *x: sizes.append(len(x[0])) or kept(*x))
    x, y = (search.np.array([r[i] for r in a]) for i in (1, 2))
    starts = search.np.cumsum([0, *held[:-1]])
    search.search_all(leaves.index, starts, search.np.array(held), px, py, search.np.arange(400), x, y, 20, None, first=1)
    assert sum(sizes) <= 3 * len(a)


def test_keys_are_numbered_in_their_order_and_pairs_can_be_shared(make):
    rng = random.Random(5)
    a = [(i, float(rng.randrange(60)), float(rng.randrange(60))) for i in range(100)]
    b = [(f"P{rng.randrange(40)}", float(rng.randrange(60)), float(rng.randrange(60))) for _ in range(90)]
    origins, destinations = make(a, "origin"), make(b, "destination")
    numbered, names = g.number_keys(destinations)
    key = {r.number: r.destination for r in names.collect()}
    assert [key[n] for n in sorted(key)] == sorted({p for p, _, _ in b})
    assert sorted((key[r.destination], r.x, r.y) for r in numbered.collect()) == sorted(b)
    pairs = g.candidate_pairs(origins, numbered, 20.0)
    for form in (g.nearest_by_window, g.nearest_distinct_on, g.nearest_sort_dedupe):
        found = form(origins, numbered, 20.0, pairs=pairs)
        assert [(o, key[n]) for o, n, _ in rows(found)] == [r[:2] for r in brute(a, b, cap=20.0)]


def code_size(df):
    """Bytes of the largest method that Spark generates for a plan; the JVM compiles none above 8000."""
    made = df._jdf.queryExecution().debug().codegenToSeq()
    return max(made.apply(i)._3().maxMethodCodeSize() for i in range(made.size()))


@pytest.mark.parametrize("keys", [0, 1_000_000])
def test_ties_with_slack_are_all_up_to_so_much_farther(make, monkeypatch, keys):
    from geonear.operators.leaves import build_leaves, search_leaves

    monkeypatch.setattr("geonear.operators.leaves.BROADCAST_KEYS", keys)
    rng = random.Random(4)
    a = [(i, rng.uniform(0, 60), rng.uniform(0, 60)) for i in range(150)] + [(900, 500.0, 0.0)]
    b = [(f"P{i:03}", float(rng.randrange(60)), float(rng.randrange(60))) for i in range(400)]
    leaves = build_leaves(make(b, "destination"), 1, 16)
    found = search_leaves(make(a, "origin"), leaves, 50.0, ties=True, slack=1.3)
    want = {}
    for o, p, d in brute(a, sorted({(x, y): (p, x, y) for p, x, y in sorted(b, reverse=True)}.values()), 400, 50.0):
        want.setdefault(o, []).append((d, p))
    want = {o: sorted(x for x in near if x[0] <= min(near)[0] * 1.3) for o, near in want.items()}
    assert {r.origin: [(m.distance, m.destination) for m in r.nearest] for r in found.collect()} == {900: [], **want}


@pytest.mark.parametrize("keys", [0, 1_000_000])
def test_nearest_on_the_sphere_stores_no_lists_and_is_compiled(spark, make, monkeypatch, keys):
    from pyspark.sql import functions as F

    monkeypatch.setattr("geonear.operators.leaves.BROADCAST_KEYS", keys)
    stored = []
    monkeypatch.setattr("geonear.session.scratch_path", lambda s, label, path=g.session.scratch_path: (
        stored.append(label) or path(s, label)))
    rng = random.Random(6)
    at = lambda: (420000.0 + 10 * rng.randrange(40), 180000.0 + 10 * rng.randrange(40))
    a = [(i, *at()) for i in range(120)] + [(7, *at()), (800, 500000.0, 180000.0), (801, None, 1.0)]
    b = [(f"P{i:03}", *at()) for i in range(150)]
    origins, destinations = make(a, "origin"), make(b, "destination")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the code is known before the plan runs
    try:
        found = g.nearest_geodesic(origins, destinations, 100.0, None)
        size = code_size(found)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert size <= 8000 and not [x for x in stored if "geodesic" in x]
    ends = ["la", "lo", "lat", "lon"]
    pairs = g.reproject_points(origins, "la", "lo").drop("x", "y").crossJoin(g.reproject_points(destinations)).select(
        "origin", "destination", g.geodesic_distance(*ends).alias("s"), g.geodesic_distance(*ends, spheroid=True).alias("t"))
    want = {}
    for r in pairs.where(F.col("s") <= 100.0).collect():
        want[r.origin] = min(want.get(r.origin, (9e9,)), (r.s, r.destination, r.t))
    assert sorted(tuple(r) for r in found.collect()) == sorted((o, d, t) for o, (_, d, t) in want.items())


def test_reprojection_is_compiled(make):
    odd = [(1, 4e5, 2e5), (2, None, 2e5), (3, 4e5, None), (4, math.nan, 2e5), (5, 4e5, math.inf)]
    moved = g.reproject_points(make(odd, "origin").repartition(2))
    found = {r.origin: (r.lat, r.lon) for r in moved.collect()}
    assert found[1] == pytest.approx((51.69874577039168, -2.001399305794228), abs=1e-12)
    assert found[2] == found[3] == (None, None) and all(math.isnan(v) for v in (*found[4], *found[5][:1]))
    assert code_size(moved) <= 8000


@pytest.mark.parametrize("block_rows", [4, 20_000])
def test_tasks_that_write_pairs_have_few_keys(make, monkeypatch, block_rows):
    from pyspark.sql import functions as F

    monkeypatch.setattr("geonear.operators.pairs.TASK_KEYS", 100)
    rng = random.Random(2)
    a = [(i, rng.uniform(0, 400), rng.uniform(0, 400)) for i in range(300)]
    b = [(f"P{i:03}", rng.uniform(0, 400), rng.uniform(0, 400)) for i in range(400)]
    origins, destinations = make(a, "origin"), make(b, "destination")
    for join, square in ((g.dwithin_join, False), (g.bbox_join, True)):
        found = join(origins, destinations, 20.0, block_rows)
        assert rows(found) == brute(a, b, 400, 20.0, square)
        most = found.groupBy(F.spark_partition_id()).agg(F.countDistinct("destination").alias("n")).agg(F.max("n")).first()[0]
        assert most <= 200
    nobody = join(origins, destinations.where("false"), 20.0, block_rows)
    assert nobody.count() == 0


def test_methods_are_compared_without_sorting_their_rows(spark, make):
    a = make([(i, float(i), 0.0) for i in range(50)] + [(None, 3.0, 0.0), (7, 9.0, 0.0)], "origin")
    b = make([(f"P{i:02}", i * 3.0, 0.0) for i in range(20)], "destination")
    near = g.nearest_distinct_on(a, b, 2.0)
    results = {"same": g.nearest(a, b, 2.0), "few": g.nearest(a, b, 0.5), "none": g.nearest(a, b, 2.0).where("false")}
    found = g.compare_methods(results, near)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("hashpartitioning(origin") <= 2  # of the reference, and of all rows
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert code_size(g.compare_methods({f"m{i}": near for i in range(13)}, near)) <= 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    expected = {r.origin: r.destination for r in near.collect()}
    for r in found.collect():
        rows_of = [(x.origin, x.destination) for x in results[r.method].collect()]
        wrong = sum(expected.get(o) != d for o, d in rows_of) + len(expected.keys() - {o for o, _ in rows_of})
        assert (r.n_rows, r.n_mismatch, r.agrees) == (len(rows_of), wrong, wrong == 0)
    assert {r.method for r in found.collect()} == set(results)


def test_comparison_counts_repeated_and_missing_answers(spark):
    schema = "origin long, destination string, distance double"
    frame = lambda rows: spark.createDataFrame([(*r, 1.0) for r in rows], schema)
    reference = frame([(1, "a"), (2, "b"), (3, None), (None, "c")])
    results = {
        "repeated": frame([(1, "a"), (1, "a"), (1, "x"), (1, "x"), (2, "b"), (3, None), (None, "c"), (None, "c")]),
        "other": frame([(1, "a"), (4, "a"), (None, "d")]),
        "empty": frame([]),
    }
    found = {r.method: tuple(r)[1:] for r in g.compare_methods(results, reference).collect()}
    # Two wrong rows and the NULL answer; an origin too many, two missing and one wrong; all missing.
    assert found == {"repeated": (8, 3, False), "other": (3, 4, False), "empty": (0, 4, False)}
    assert g.compare_methods({}, reference).count() == 0


def test_report_shares_its_leaves(spark, dense, monkeypatch):
    stored = []
    monkeypatch.setattr("geonear.session.scratch_path", lambda s, label, path=g.session.scratch_path: (
        stored.append(label) or path(s, label)))
    contract.compare_methods_report(spark, dense)
    assert stored.count("leaves") <= 5  # k of 1, 5, 10 and 100, and those of the ties


@pytest.mark.parametrize("keys", [0, 1_000_000])
def test_forms_with_shared_leaves_agree_with_their_own(make, monkeypatch, keys):
    monkeypatch.setattr("geonear.operators.leaves.BROADCAST_KEYS", keys)
    rng = random.Random(7)
    at = lambda: (420000.0 + 10 * rng.randrange(60), 180000.0 + 10 * rng.randrange(60))
    origins = make([(i, *at()) for i in range(80)], "origin")
    destinations = make([(f"P{i:03}", *at()) for i in range(120)], "destination")
    leaves = g.build_leaves(destinations)
    both = origins, destinations, 60.0
    for form in (g.nearest_lateral, g.nearest_in_square, g.nearest_in_hex_disk, g.nearest_geodesic, g.candidate_pairs):
        assert rows(form(*both, leaves=leaves)) == rows(form(*both))
    assert rows(g.nearest(*both, leaves=leaves)) == rows(g.nearest(*both))
    with pytest.raises(ValueError, match="k=1"):
        g.knn_join(*both[:2], 5, leaves=leaves)


def test_numbers_are_sent_up_to_more_keys_than_text(spark, monkeypatch):
    monkeypatch.setattr("geonear.operators.leaves.BROADCAST_KEYS", 100)
    points = spark.range(250).selectExpr("id as destination", "id * 7.0D as x", "id * 3.0D as y")
    assert g.build_leaves(points).whole is not None
    assert g.build_leaves(points.selectExpr("cast(destination as string) as destination", "x", "y")).whole is None
    assert g.build_leaves(points.unionAll(points.selectExpr("destination", "x + 1", "y"))).whole is None


def test_origins_read_in_enough_parts_are_searched_where_they_are(spark, make, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(3000).selectExpr("id as origin", "id * 1.0D as x", "0.0D as y").repartition(cores).write.parquet(f"{tmp_path}/a")
    b = make([(f"P{i:02}", i * 100.0, 1.0) for i in range(30)], "destination")
    with_parts = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a part for each file
    try:
        found = g.nearest(spark.read.parquet(f"{tmp_path}/a"), b)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", with_parts)
    few = g.nearest(spark.read.parquet(f"{tmp_path}/a").coalesce(1), b)
    assert few.rdd.getNumPartitions() == cores and few.count() == 3000


def test_first_of_many_where_the_other_leaves_are_crowded(make, monkeypatch):
    from geonear.functions import search

    rng = random.Random(10)
    a = [(i, 100.0 + rng.random(), 0.0) for i in range(40)]
    # The cap leaves few of an origin's own leaf, and a cluster in reach of it.
    b = [(f"F{i:03}", 100.0, 30.0 + i) for i in range(60)]
    b += [(f"C{i:03}", 90.0 + rng.random(), rng.random()) for i in range(500)]
    kept, given = search.nearest_of, []
    monkeypatch.setattr(search, "nearest_of", lambda row, *x: given.append(len(row)) or kept(row, *x))
    xs, ys = (search.np.array([r[i] for r in b]) for i in (1, 2))
    far, near = search.np.arange(60), search.np.arange(60, 560)
    index = search.leaf_index(search.np.array([0, 1]), *(search.np.array([f(v[near]), f(v[far])]) for v in (xs, ys) for f in (min, max)),
                              search.np.array([500, 60]))
    px, py, order = (search.np.r_[v[near], v[far]] for v in (xs, ys, search.np.arange(560)))
    x, y = (search.np.array([r[i] for r in a]) for i in (1, 2))
    row, slot, d = search.search_all(index, search.np.array([0, 500]), search.np.array([500, 60]), px, py, order, x, y, 5, 40.0, first=1)
    assert [(a[r][0], b[order[s]][0], v) for r, s, v in zip(row, slot, d)] == brute(a, b, cap=40.0)
    assert max(given) <= 40 * (5 + 5 + 10)  # not the 500 of the cluster for each origin
    assert rows(g.knn_join_top1(make(a, "origin"), make(b, "destination"), 5, 40.0)) == brute(a, b, cap=40.0)


def test_neighbours_are_put_in_order_once_they_are_selected(monkeypatch):
    from geonear.functions import search

    rng, k, sizes = random.Random(11), 20, []
    kept = search.first_k
    monkeypatch.setattr(search, "first_k", lambda *x: sizes.append(len(x[0])) or kept(*x))
    a = [(i, rng.uniform(0, 60), rng.uniform(0, 60)) for i in range(100)]
    b = sorted((f"P{i:03}", rng.uniform(0, 60), rng.uniform(0, 60)) for i in range(400))
    b = [p for half in (False, True) for p in b if (p[1] >= 30) == half]  # two leaves, side by side
    px, py = (search.np.array([p[i] for p in b]) for i in (1, 2))
    order = search.np.argsort(search.np.argsort([p[0] for p in b]))
    n = sum(p[1] < 30 for p in b)
    starts, held = search.np.array([0, n]), search.np.array([n, 400 - n])
    box = [f.reduceat(v, starts) for v in (px, py) for f in (search.np.minimum, search.np.maximum)]
    index = search.leaf_index(search.np.arange(2), *box, held)
    x, y = (search.np.array([r[i] for r in a]) for i in (1, 2))
    row, slot, d = search.search_all(index, starts, held, px, py, order, x, y, k, None)
    assert sorted((a[r][0], b[s][0], v) for r, s, v in zip(row, slot, d)) == brute(a, b, k)
    assert sum(sizes) <= k * len(a)
