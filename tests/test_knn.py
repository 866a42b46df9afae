import random

import numpy as np
import pytest
from conftest import brute, rows

import geonear as g
from geonear.functions.ranking import k_smallest_bound


def points(rng, n, kind, shape):
    made = []
    for i in range(n):
        if shape == "lattice":  # many ties and shared coordinates
            x, y = rng.randrange(12) * 100.0, rng.randrange(9) * 100.0
        elif shape == "uniform":
            x, y = rng.uniform(-3000, 3000), rng.uniform(-2000, 2000)
        else:  # a third on one spot, a third in a tight cluster, the rest sparse
            part = i % 3
            if part == 0:
                x, y = 1000.0, 1000.0
            elif part == 1:
                x, y = 1000 + rng.gauss(0, 3), 1010 + rng.gauss(0, 3)
            else:
                x, y = rng.uniform(-20000, 20000), rng.uniform(-20000, 20000)
        made.append((i if kind == "origin" else f"P{i:04d}", x, y))
    return made


@pytest.mark.parametrize(
    "shape, k, cap, leaf",
    [
        ("lattice", 3, None, 24),
        ("uniform", 1, 700.0, 8),
        ("uniform", 4, 900.0, 32),
        ("skewed", 1, 5000.0, 8),
        ("skewed", 5, None, 40),
    ],
)
def test_tiles_agree_with_brute_force(make, shape, k, cap, leaf):
    rng = random.Random(f"{shape}{k}{cap}")
    a, b = points(rng, 150, "origin", shape), points(rng, 240, "destination", shape)
    origins, destinations = make(a, "origin"), make(b, "destination")
    tiles = g.build_tiles(destinations, origins, k, cap, leaf_size=leaf)
    assert rows(g.knn_join(origins, destinations, tiles=tiles)) == brute(a, b, k, cap)


def test_square_agrees_with_brute_force(make):
    rng = random.Random(5)
    a, b = points(rng, 150, "origin", "uniform"), points(rng, 60, "destination", "uniform")
    origins, destinations = make(a, "origin"), make(b, "destination")
    tiles = g.build_tiles(destinations, origins, 1, 500.0, square=True, leaf_size=8)
    found = rows(g.nearest_in_square(origins, destinations, 500.0, tiles=tiles))
    assert found == brute(a, b, 1, 500.0, square=True)


def test_hot_cells_keep_candidate_lists_short(make):
    """A crowd next to a tile must not end up in the tile's list."""
    rng = random.Random(11)
    crowd = [(f"C{i:05d}", 5000 + rng.random(), 5000 + rng.random()) for i in range(3000)]
    spot = [(f"S{i:05d}", 100.0, 100.0) for i in range(3000)]
    sparse = [(f"Z{i:05d}", rng.uniform(0, 10000), rng.uniform(0, 10000)) for i in range(60)]
    origins = [(1, 4990.0, 4990.0), (2, 100.0, 101.0), (3, 5000.5, 5000.5), (4, 2500.0, 4000.0)]
    everything = make(crowd + spot + sparse, "destination")
    tiles = g.build_tiles(everything, asking := make(origins, "origin"), 1, 5000.0, leaf_size=64)
    longest = tiles.table.selectExpr("max(size(candidates)) as n").first().n
    assert longest <= 64
    found = rows(g.knn_join(asking, None, tiles=tiles))
    assert found == brute(origins, crowd + spot + sparse, 1, 5000.0)


def test_equal_distances_go_to_the_smallest_key(make):
    o = make([(1, 0.0, 0.0)], "origin")
    d = make([("B", 3.0, 4.0), ("A", 4.0, 3.0)], "destination")
    assert rows(g.nearest(o, d, 5000.0)) == [(1, "A", 5.0)]
    assert rows(g.nearest_all_ties(o, d, 5000.0)) == [(1, "A", 5.0), (1, "B", 5.0)]
    assert rows(g.nearest_first_of_ties(o, d, 5000.0)) == [(1, "A", 5.0)]


def test_ties_include_every_key_at_a_shared_coordinate(make):
    o = make([(1, 0.0, 0.0)], "origin")
    d = make([("B", 3.0, 4.0), ("A", 3.0, 4.0), ("C", -3.0, 4.0), ("D", 9.0, 9.0)], "destination")
    assert [r[1] for r in rows(g.nearest_all_ties(o, d, 100.0))] == ["A", "B", "C"]


def test_cap_is_inclusive_and_round(make):
    o = make([(1, 0.0, 0.0)], "origin")
    on_edge = make([("P", 3000.0, 4000.0)], "destination")
    corner = make([("Q", 4000.0, 4000.0)], "destination")
    assert rows(g.nearest(o, on_edge, 5000.0)) == [(1, "P", 5000.0)]
    assert rows(g.nearest(o, corner, 5000.0)) == []
    assert [r[1] for r in rows(g.nearest_in_square(o, corner, 5000.0))] == ["Q"]


def test_rounding_before_or_after_ranking(make):
    o = make([(1, 0.0, 0.0)], "origin")
    d = make([("A", 10.004, 0.0), ("B", 10.001, 0.0)], "destination")
    assert [r[1] for r in rows(g.nearest(o, d, round_to=2))] == ["B"]
    assert rows(g.knn_rounded_first(o, d, 5)) == [(1, "A", 10.0)]


def test_unmatched_origins(make):
    o = make([(1, 0.0, 0.0), (2, 90000.0, 0.0), (3, None, 1.0)], "origin")
    d = make([("P", 1.0, 0.0), ("N", None, None)], "destination")
    assert rows(g.nearest(o, d, 5000.0)) == [(1, "P", 1.0)]
    left = {r[0]: r[1:] for r in g.nearest(o, d, 5000.0, how="left").collect()}
    assert left == {1: ("P", 1.0), 2: (None, None), 3: (None, None)}


def test_no_destinations(make):
    o, none = make([(1, 0.0, 0.0)], "origin"), make([], "destination")
    assert rows(g.nearest(o, none, 5000.0)) == []
    assert rows(g.nearest(o, none)) == []
    assert g.nearest(o, none, 5000.0, how="left").count() == 1


def test_one_place_only(make):
    o = make([(1, 7.0, 7.0)], "origin")
    d = make([("A", 7.0, 7.0), ("B", 7.0, 7.0)], "destination")
    assert rows(g.knn_join(o, d, 2)) == [(1, "A", 0.0), (1, "B", 0.0)]


def test_arguments_are_checked(make):
    d = make([("A", 0.0, 0.0)], "destination")
    o = make([(1, 0.0, 0.0)], "origin")
    for bad in (dict(k=0), dict(square=True), dict(max_distance=-1.0)):
        with pytest.raises(ValueError):
            g.build_tiles(d, o, **bad)


def test_all_variants_agree(make):
    rng = random.Random(3)
    a, b = points(rng, 120, "origin", "lattice"), points(rng, 90, "destination", "lattice")
    o, d = make(a, "origin"), make(b, "destination")
    tiles = g.build_tiles(d, o, 1, 150.0)
    want = brute(a, b, 1, 150.0)
    for variant in (g.nearest_by_window, g.nearest_distinct_on, g.nearest_lateral):
        assert rows(variant(o, d, 150.0, round_to=None, tiles=tiles)) == want, variant
    assert rows(g.nearest_sort_dedupe(o, d, 150.0, tiles=tiles)) == want
    assert rows(g.nearest_all_vs_all(o, d)) == brute(a, b)
    assert rows(g.knn_join_top1(o, d, 10)) == brute(a, b)


def test_plans_have_no_pair_loop_and_one_python_pass(make):
    rng = random.Random(3)
    o = make(points(rng, 50, "origin", "uniform"), "origin")
    d = make(points(rng, 50, "destination", "uniform"), "destination")
    tiles = g.build_tiles(d, o, 1, 500.0)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    for df in (
        g.knn_join(o, d, tiles=tiles),
        g.nearest_by_window(o, d, 500.0, tiles=tiles),
        g.nearest_distinct_on(o, d, 500.0, tiles=tiles),
        g.nearest_lateral(o, d, 500.0, tiles=tiles),
        g.dwithin_join(o, d, 500.0),
    ):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)
    flagship = plan(g.knn_join(o, d, tiles=tiles))
    assert flagship.count("ArrowEvalPython") == 1
    assert "Exchange hashpartitioning" not in flagship


def test_hex_disk_limits_the_search(make):
    o = make([(1, 0.0, 0.0), (2, 0.0, 0.0)], "origin")
    d = make([("near", 900.0, 0.0), ("far", 4000.0, 0.0)], "destination")
    assert rows(g.nearest_in_hex_disk(o, d, 5000.0)) == [(1, "near", 900.0), (2, "near", 900.0)]
    only_far = make([("far", 4000.0, 0.0)], "destination")
    assert rows(g.nearest_in_hex_disk(o, only_far, 5000.0)) == []
    assert [r[1] for r in rows(g.nearest_in_hex_disk(o, only_far, 5000.0, exact=True))] == ["far", "far"]


def test_bound_of_the_k_smallest():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 700, 200)
    starts = np.r_[0, np.cumsum(sizes)]
    d = rng.integers(0, 50, starts[-1]).astype(float)  # many ties
    d[rng.random(len(d)) < 0.1] = np.inf
    for k in (2, 5, 100):
        bound = k_smallest_bound(d, starts[:-1], sizes, k)
        for i, n in enumerate(sizes):
            assert bound[i] == (np.sort(d[starts[i]:starts[i + 1]])[k - 1] if n > k else np.inf)
