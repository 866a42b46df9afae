"""Origins meet the tile they lie in by its interval of the curve, one row each."""

import random

import pytest
from conftest import brute, rows
from pyspark.sql import functions as F

import geonear as g
from geonear.operators import tiles as tl


def clustered(seed, n):
    rng = random.Random(seed)
    out = [(rng.uniform(-4e4, 4e4), rng.uniform(-4e4, 4e4)) for _ in range(n // 3)]
    return out + [(500 + rng.gauss(0, 30), -900 + rng.gauss(0, 30)) for _ in range(n - len(out))]


@pytest.mark.parametrize("most,broadcast", [(1 << 20, True), (1 << 20, False), (5, False)])
def test_each_origin_leaves_once(spark, make, monkeypatch, most, broadcast):
    monkeypatch.setattr(tl, "MAX_INTERVALS", most)
    origins = [(i, x, y) for i, (x, y) in enumerate(clustered(1, 300))]
    destinations = [(f"d{i}", x, y) for i, (x, y) in enumerate(clustered(2, 600))]
    a, b = make([*origins, (900, None, 0.0)], "origin"), make(destinations, "destination")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if not broadcast:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tiles = g.build_tiles(b, a, 2, None, leaf_size=16)
        assert len(tiles.levels) > 2
        located = tiles.locate(a)
        assert located.count() == len(origins)
        assert located.join(tiles.table, tl.TILE_KEY).count() == len(origins)
        answer = g.knn_join(a, b, 2, tiles=tiles)
        assert "NestedLoop" not in answer._jdf.queryExecution().toString()
        assert rows(answer) == brute(origins, destinations, 2)
        # Points in no kept tile have no row.
        assert tiles.locate(make([(1, 9e9, 9e9), (2, -9e9, 0.0)], "origin")).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_columns_of_origins_stay(spark, make):
    a = make([(i, x, y) for i, (x, y) in enumerate(clustered(3, 90))], "origin").withColumn("note", F.lit("n"))
    tiles = g.build_tiles(make([(f"d{i}", x, y) for i, (x, y) in enumerate(clustered(4, 300))], "destination"), a, leaf_size=8)
    assert tiles.locate(a).columns == ["origin", "x", "y", "note", *tl.TILE_KEY]
