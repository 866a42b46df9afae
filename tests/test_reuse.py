"""Shared tiles, odd coordinates and odd keys: no silent wrong answers."""

import math
import os
import sqlite3
import struct

import pytest

import geonear as g
from conftest import brute, rows


def frames(spark):
    o = spark.createDataFrame([(1, 0.0, 0.0), (2, 4000.0, 0.0), (3, 9000.0, 0.0)], "origin long, x double, y double")
    d = spark.createDataFrame([("A", 5.0, 0.0), ("B", 4003.0, 0.0), ("C", 9004.0, 0.0)],
                              "destination string, x double, y double")
    return o, d


def test_tiles_are_bound_to_their_query(spark):
    o, d = frames(spark)
    tiles = g.build_tiles(d, o, 1, 5000.0)
    assert len(rows(g.nearest(o, d, 5000.0, tiles=tiles))) == 3
    for call in (lambda: g.nearest(o, d, 1.0, tiles=tiles), lambda: g.knn_join(o, d, k=3, tiles=tiles),
                 lambda: g.nearest_in_square(o, d, 5000.0, tiles=tiles),
                 lambda: g.nearest(o.where("origin = 1"), d, 5000.0, tiles=tiles),
                 lambda: g.nearest(o, d.where("x > 9"), 5000.0, tiles=tiles)):
        with pytest.raises(ValueError, match="built for"):
            call()
    five = g.build_tiles(d, o, 5, 5000.0)
    with pytest.raises(ValueError, match="built for k=5"):
        g.nearest_all_ties(o, d, 5000.0, tiles=five)


@pytest.mark.parametrize("cap", [None, 5000.0])
@pytest.mark.parametrize("bad", [float("nan"), math.inf, None])
def test_coordinates_that_are_no_numbers(spark, cap, bad):
    a = [(1, 3990.0, 0.0), (2, bad, 0.0), (3, 0.0, bad)]
    b = [("A", 0.0, 0.0), ("N", bad, 0.0)]
    o = spark.createDataFrame(a, "origin long, x double, y double")
    d = spark.createDataFrame(b, "destination string, x double, y double")
    assert rows(g.nearest(o, d, cap)) == [(1, "A", 3990.0)]
    assert {r["origin"]: r["destination"] for r in g.nearest(o, d, cap, how="left").collect()} == {
        1: "A", 2: None, 3: None}


def test_left_join_of_repeated_and_null_ids(spark):
    o = spark.createDataFrame([(1, 0.0, 0.0), (1, 50.0, 0.0), (None, 5.0, 4.2), (4, 90000.0, 0.0)],
                              "origin long, x double, y double")
    d = spark.createDataFrame([("A", 5.0, 0.0)], "destination string, x double, y double")
    got = [(r[0], r[1], r[2]) for r in g.nearest(o, d, 100.0, how="left").collect()]
    assert sorted(got, key=repr) == sorted(
        [(1, "A", 5.0), (1, "A", 45.0), (None, "A", 4.2), (4, None, None)], key=repr)


def test_only_tiles_with_origins_are_kept(spark):
    d = spark.createDataFrame([(f"D{i}", (i % 50) * 0.2, (i // 50) * 0.2) for i in range(2500)],
                              "destination string, x double, y double")
    o = spark.createDataFrame([(i, (i * 37 % 4000) - 2000.0, (i * 91 % 4000) - 2000.0) for i in range(100)],
                              "origin long, x double, y double")
    tiles = g.build_tiles(d, o, 1, 5000.0)
    assert tiles.table.count() <= 2 * 100
    want = brute([tuple(r) for r in o.collect()], [tuple(r) for r in d.collect()], 1, 5000.0)
    assert rows(g.nearest(o, d, 5000.0, tiles=tiles)) == want


def test_report_of_ties_and_gaps(spark):
    kind = "origin long, destination string, distance double"
    reference = spark.createDataFrame([(1, "A", 1.0), (2, "B", 1.0)], kind)
    ties = spark.createDataFrame([(1, "A", 1.0), (1, "Z", 1.0), (2, "B", 1.0), (3, None, None)], kind)
    empty = spark.createDataFrame([], kind)
    got = g.compare_methods({"ties": ties, "empty": empty, "same": reference}, reference).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {
        "ties": (4, 2, False), "empty": (0, 2, False), "same": (2, 0, True)}
    for name, df in (("ties", ties), ("empty", empty)):
        assert g.check(df, reference).count() == {r["method"]: r["n_mismatch"] for r in got}[name]


def test_null_keys_are_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    rows_ = spark.createDataFrame([(None, 1), (2, 2)], "k long, v long")
    rows_.where("k = 2").write.orc(path)
    with pytest.raises(Exception, match="k is NULL"):
        g.insert_new_keys(spark, path, rows_, "k", ["v"])


def _geopackage(path, columns, ids):
    with sqlite3.connect(path) as db:
        db.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
        db.execute("insert into gpkg_geometry_columns values ('l', 'geometry')")
        db.execute(f"create table l (fid integer primary key, geometry blob, {', '.join(c + ' text' for c in columns)})")
        blob = struct.pack("<2sBBi", b"GP", 0, 1, 27700) + struct.pack("<BIdd", 1, 1, 1.0, 2.0)
        for i in ids:
            db.execute(f"insert into l values (?, ?, {', '.join('?' * len(columns))})", (i, blob, *columns))


def test_geopackage_columns_by_name_and_sparse_ids(spark, tmp_path):
    _geopackage(tmp_path / "a.gpkg", ("postcode", "county"), [1, 2])
    _geopackage(tmp_path / "b.gpkg", ("county", "postcode"), [1, 10**12])
    layer = g.read_geopackage(spark, str(tmp_path), "l", rows_per_partition=1)
    assert layer.rdd.getNumPartitions() <= 4
    assert {(r["postcode"], r["county"]) for r in layer.collect()} == {("postcode", "county")} and layer.count() == 4
    os.mkdir(tmp_path / "c")
    _geopackage(tmp_path / "c" / "a.gpkg", ("postcode", "county"), [1])
    _geopackage(tmp_path / "c" / "b.gpkg", ("postcode",), [1])
    with pytest.raises(Exception, match="lacks columns"):
        g.read_geopackage(spark, str(tmp_path / "c"), "l").collect()
