"""Polygon cells against a plain crossing count, in integers."""

import math
import random

import pytest
from pyspark.sql import functions as F

import geonear as g

EDGES = "name string, x1 double, y1 double, x2 double, y2 double"


def ring(name, corners):
    return [(name, *map(float, a), *map(float, b)) for a, b in zip(corners, corners[1:] + corners[:1])]


def plain_inside(px, py, edges):
    odd = False
    for _, ax, ay, bx, by in edges:
        side = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
        if side == 0 and min(ax, bx) <= px <= max(ax, bx) and min(ay, by) <= py <= max(ay, by):
            return True
        if (ay <= py < by and side < 0) or (by <= py < ay and side > 0):
            odd = not odd
    return odd


def plain_join(points, edges):
    names = {e[0] for e in edges}
    return sorted(((i, n) for n in names for i, x, y in points if plain_inside(x, y, [e for e in edges if e[0] == n])), key=str)


def star(rng, corners, radius, cx=0, cy=0):
    """A simple polygon with integer corners around a centre."""
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
    return [(cx + round(rng.uniform(0.2, 1) * radius * math.cos(a)), cy + round(rng.uniform(0.2, 1) * radius * math.sin(a)))
            for a in angles]


@pytest.mark.parametrize("seed", [1, 2])
def test_cells_equal_a_crossing_count(spark, seed):
    rng = random.Random(seed)
    edges = []
    for i, (corners, radius) in enumerate([(3, 20), (5, 40), (12, 30), (60, 60), (200, 90)]):
        edges += ring(f"p{i}", star(rng, corners, radius, rng.randrange(-20, 20), rng.randrange(-20, 20)))
    # A lattice polygon with holes and steps, whose corners are often where cells begin.
    edges += ring("steps", [(0, 0), (32, 0), (32, 8), (24, 8), (24, 16), (16, 16), (16, 24), (8, 24), (8, 32), (0, 32)])
    edges += ring("steps", [(4, 4), (12, 4), (12, 12), (4, 12)]) + ring("steps", [(8, 16), (8, 20), (4, 20)])
    edges += ring("flat", [(0, 0), (50, 0), (20, 0)]) + ring(None, [(0, 0), (10, 0), (10, 10), (0, 10)])
    edges = [e for e in edges if (e[1], e[2]) != (e[3], e[4])]
    points = [(x * 200 + y, float(x - 100), float(y - 100)) for x in range(0, 200, 3) for y in range(0, 200, 3)]
    points += [(50_000 + i, x, y) for i, (_, x, y, _, _) in enumerate(edges)]
    points += [(60_000, None, 1.0), (60_001, float("nan"), 1.0), (60_002, 1.0, float("inf"))]
    found = g.points_in_polygons(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(edges, EDGES))
    known = [p for p in points if p[1] is not None and abs(p[1]) + abs(p[2]) < float("inf")]
    assert sorted(((r.id, r.name) for r in found.collect()), key=str) == plain_join(known, edges)


def test_a_comb_has_few_edges_in_every_cell(spark):
    teeth = 3000
    corners = [(0, -10), (10 * teeth, -10)]
    for i in reversed(range(teeth)):
        corners += [(10 * i + 8, 0), (10 * i + 5, 100_000), (10 * i + 2, 0)]
    edges = ring("comb", corners)
    cut = g.cut_polygons(spark.createDataFrame(edges, EDGES))
    held = cut.cells.select(F.size("edges").alias("n")).agg(
        F.max("n").alias("most"), F.sum("n").alias("all"), F.count("*").alias("cells"), F.count_if(F.col("n") == 0).alias("empty")).first()
    assert held["most"] <= 24 and held["all"] < 12 * len(edges) and held["cells"] < 6 * len(edges)
    rng = random.Random(4)
    points = [(i, float(rng.randrange(0, 10 * teeth)), float(rng.randrange(-10, 100_001))) for i in range(300)]
    found = g.points_in_polygons(spark.createDataFrame(points, "id int, x double, y double"), cut)
    assert sorted(((r.id, r.name) for r in found.collect()), key=str) == plain_join(points, edges)


def test_inside_cells_need_no_edge_and_no_python(spark):
    square = ring("s", [(0, 0), (1000, 0), (1000, 1000), (0, 1000)])
    cut = g.cut_polygons(spark.createDataFrame(square, EDGES))
    assert cut.cells.where("size(edges) = 0 and odd").count() >= 2
    assert cut.cells.where("size(edges) = 0 and not odd").count() == 0
    points = spark.createDataFrame([(1, 500.0, 500.0)], "id int, x double, y double")
    plan = g.points_in_polygons(points, cut)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan
