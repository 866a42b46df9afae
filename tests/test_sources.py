import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

import geonear as g
from geonear.sources.files import by_name, new_keys


def test_wkt(spark):
    texts = ["POINT(1 2)", "POINT (1.5 -2e3)", "point( -.5 +4. )", None, "POINT EMPTY", "LINESTRING(0 0, 1 1)",
             "POINT(1 2"]
    df = spark.createDataFrame([(t,) for t in texts], "wkt string")
    got = [(r.x, r.y) for r in g.decode_wkt(df).collect()]
    assert got == [(1.0, 2.0), (1.5, -2000.0), (-0.5, 4.0)] + [(None, None)] * 4
    back = g.encode_wkt(spark.createDataFrame([(1.0, 2.0), (None, 1.0)], "x double, y double"))
    assert [r.wkt for r in back.collect()] == ["POINT(1.0 2.0)", None]


def test_wkb(spark):
    one = "0101000000000000000000F03F0000000000000040"
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (-0.25, 1e300)], "x double, y double").coalesce(1)
    assert [r.wkb for r in g.encode_wkb(df, as_hex=True).collect()][:2] == [one, None]
    blobs = [
        bytes.fromhex(one),
        struct.pack(">BIdd", 0, 1, 3.0, 4.0),
        struct.pack("<BIIdd", 1, 0x20000001, 27700, 5.0, 6.0),
        struct.pack(">BIIdd", 0, 0x20000001, 4326, 7.0, 8.0),
        None,
        b"\x01\x02",
        struct.pack("<BIdd", 1, 2, 9.0, 9.0),
    ]
    for parts in (1, 4):
        df = spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "i int, wkb binary").repartition(parts)
        got = {r.i: (r.x, r.y, r.srid) for r in g.decode_wkb(df, srid="srid").collect()}
        assert got == {0: (1.0, 2.0, None), 1: (3.0, 4.0, None), 2: (5.0, 6.0, 27700), 3: (7.0, 8.0, 4326),
                       4: (None,) * 3, 5: (None,) * 3, 6: (None,) * 3}


def test_by_name_ignores_case_and_order(spark):
    target = spark.createDataFrame([(1, "a", 2.0)], "id long, name string, extra double")
    batch = spark.createDataFrame([("b", 7, "x")], "NAME string, Id int, other string")
    assert [tuple(r) for r in by_name(batch, target.schema).collect()] == [(7, "b", None)]
    assert g.append_by_name(batch, target).count() == 2


def test_existing_keys_win(spark, tmp_path):
    path = str(tmp_path / "t.orc")
    spark.createDataFrame([(1, "old")], "k long, v string").write.orc(path)
    batch = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a")], "k long, v string")
    assert new_keys(spark.read.orc(path), batch, "k", ["v"]).count() == 1
    for _ in range(2):
        g.insert_new_keys(spark, path, batch, "k", ["v"])
    assert sorted(map(tuple, spark.read.orc(path).collect())) == [(1, "old"), (2, "a")]


def test_result_csv(spark, tmp_path):
    path = str(tmp_path / "r.csv")
    df = spark.createDataFrame([(1, "A,B", 0.1), (2, "C", 2.5)], "origin long, destination string, distance double")
    g.write_result_csv(df, path)
    assert sorted(map(tuple, g.read_result_csv(spark, path).collect())) == [(1, "A,B", 0.1), (2, "C", 2.5)]
    g.write_result_csv(df, path, decimals=6, single_file=True)
    (part,) = [p for p in (tmp_path / "r.csv").iterdir() if p.suffix == ".csv"]
    assert sorted(part.read_text().split()) == ['1,"A,B",0.100000', "2,C,2.500000", "origin,destination,distance"]


def geopackage(path, layer, rows):
    """A layer of (name, geometry blob, envelope code, little-endian header)."""
    with sqlite3.connect(path) as db:
        db.execute("create table gpkg_contents (table_name text, data_type text)")
        db.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
        db.execute("insert into gpkg_geometry_columns values (?, 'geom')", (layer,))
        db.execute(f'create table "{layer}" (fid integer primary key, name text(30), geom blob, area double, n mediumint)')
        for name, wkb, code, little in rows:
            blob = None
            if wkb is not None:
                head = b"GP" + bytes([0, (code << 1) | little])
                head += struct.pack("<i" if little else ">i", 27700)
                blob = head + b"\0" * {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[code] + wkb
            db.execute(f'insert into "{layer}" (name, geom, area, n) values (?, ?, 1.5, 3)', (name, blob))


def polygon(order, *rings):
    out = struct.pack(order + "BII", order == "<", 3, len(rings))
    for ring in rings:
        out += struct.pack(order + "I", len(ring)) + b"".join(struct.pack(order + "dd", *p) for p in ring)
    return out


def test_geopackage_points_and_partitions(spark, tmp_path):
    path = str(tmp_path / "a.gpkg")
    rows = [(f"p{i}", struct.pack("<BIdd", 1, 1, i, -i), i % 5, i % 2) for i in range(25)] + [("none", None, 0, 1)]
    geopackage(path, "pts", rows)
    df = g.read_geopackage(spark, path, "pts", rows_per_partition=4)
    assert df.columns == ["fid", "name", "area", "n", "srs_id", "wkb"]
    assert df.rdd.getNumPartitions() == 7
    got = {r.name: (r.x, r.y, r.srs_id, r.n) for r in g.decode_wkb(df).collect()}
    assert got["p7"] == (7.0, -7.0, 27700, 3) and got["none"] == (None, None, None, 3) and len(got) == 26


def test_geopackage_polygons(spark, tmp_path):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    hole = [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0), (4.0, 4.0)]
    far = [(20.0, 0.0), (22.0, 0.0), (22.0, 2.0), (20.0, 0.0)]
    multi = struct.pack("<BII", 1, 6, 2) + polygon("<", square, hole) + polygon(">", far)
    geopackage(str(tmp_path / "d.gpkg"), "district", [("M", multi, 1, 1), ("P", polygon(">", far), 0, 0)])
    edges = g.polygon_edges(g.read_geopackage(spark, str(tmp_path), "district"))
    assert edges.groupBy("name").count().orderBy("name").collect() == [("M", 11), ("P", 3)]
    pts = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (4.0, 5.0), (21.5, 1.0), (30.0, 0.0)], "x double, y double")
    found = sorted((r["name"], r.x) for r in g.points_in_polygons(pts, edges).collect())
    assert found == [("M", 1.0), ("M", 4.0), ("M", 21.5), ("P", 21.5)]


def test_prepare_and_load(spark, tmp_path):
    from geonear.plans.prepare import POSTCODE_SCHEMA, PROPERTY_SCHEMA

    v = [("D", 0, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)])]
    edges = g.ring_edges(spark.createDataFrame(v, "name string, ring int, seq int, x double, y double"))
    raw = spark.createDataFrame(
        [("1", 5.0, 5.0, "51", "-1"), ("2", 50.0, 5.0, "51", "-1"), ("3", 10.0, 3.0, "52", "-2")],
        "UPRN string, X_COORDINATE double, Y_COORDINATE double, LATITUDE string, LONGITUDE string")
    codes = spark.createDataFrame([("B", 1.0, 1.0), ("A", 1.0, 1.0), ("C", 99.0, 0.0)],
                                  "postcode string, x double, y double")
    origins, destinations = g.prepare(raw, codes, edges, "D", str(tmp_path / "out"))
    table = g.load_serving_table(spark, origins, str(tmp_path / "p"), "uprn", PROPERTY_SCHEMA)
    assert sorted((r.uprn, r.lat, r.wkt) for r in table.collect()) == [
        (1, 51.0, "POINT(5.0 5.0)"), (3, 52.0, "POINT(10.0 3.0)")]
    codes = g.load_serving_table(spark, destinations, str(tmp_path / "c"), "postcode", POSTCODE_SCHEMA)
    assert [(r.postcode, r.geom.x) for r in codes.collect()] == [("A,B", 1.0)]


def test_geopackage_filters_are_answered_in_the_file(spark, tmp_path):
    path = str(tmp_path / "f.gpkg")
    wkb = struct.pack("<BIdd", 1, 1, 1.0, 2.0)
    geopackage(path, "pts", [(f"n{i:03}" if i % 5 else None, wkb, 0, 1) for i in range(200)])
    with sqlite3.connect(path) as db:
        # The format's own index over the layer, as a plain table here.
        db.execute("create table rtree_pts_geom (id integer, minx real, maxx real, miny real, maxy real)")
        db.executemany("insert into rtree_pts_geom values (?, ?, ?, 0, 0)", [(i, i, i) for i in range(1, 201)])

    def left_the_reader(df):
        plan = df._jdf.queryExecution().executedPlan()
        rows = df.collect()
        leaf = plan.collectLeaves().apply(0)
        return len(rows), leaf.metrics().get("numOutputRows").get().value()

    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        read = lambda *where: g.read_geopackage(spark, path, "pts", where=list(where)).select("fid", "name", "area")
        assert left_the_reader(read()) == (200, 200)
        assert left_the_reader(read(("name", "=", "n007"))) == (1, 1)
        assert left_the_reader(read(("fid", ">", 190), ("name", "<>", ""), ("area", "<", 2))) == (8, 8)
        assert left_the_reader(read(("name", "in", ["n001", "n002", "zz"]))) == (2, 2)
        both = read(("name", "=", "n007")).unionByName(read(("name", "=", "n008")))
        assert sorted(r.name for r in both.collect()) == ["n007", "n008"]
        with pytest.raises(Exception, match="no comparison"):
            read(("name; drop", "=", 1)).collect()
        boxed = g.read_geopackage(spark, path, "pts", box=(10, -1, 19, 1))
        assert left_the_reader(boxed) == (10, 10)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)


def test_ids_with_huge_gaps_make_few_partitions(spark, tmp_path):
    path = str(tmp_path / "g.gpkg")
    geopackage(path, "pts", [("a", None, 0, 1), ("b", None, 0, 1)])
    with sqlite3.connect(path) as db:
        db.execute("insert into pts (fid, name) values (?, 'c')", (1 << 60,))
    df = g.read_geopackage(spark, path, "pts", rows_per_partition=1)
    assert sorted(r.name for r in df.collect()) == ["a", "b", "c"] and df.rdd.getNumPartitions() <= 8


def test_clustered_orc_reads_less_for_a_box(spark, tmp_path):
    points = spark.range(200_000).selectExpr(
        "id", "cast(pmod(hash(id, 1), 40000) as double) as x", "cast(pmod(hash(id, 2), 40000) as double) as y").repartition(4)
    read = {}
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        for clustered in (False, True):
            path = str(tmp_path / f"{clustered}.orc")
            g.write_points_orc(points, path, clustered=clustered)
            df = g.read_points_orc(spark, path).where("x between 1000 and 2000 and y between 1000 and 2000").select("id")
            plan = df._jdf.queryExecution().executedPlan()
            ids = sorted(r.id for r in df.collect())
            leaf = plan.collectLeaves().apply(0)
            read[clustered] = ids, leaf.metrics().get("numOutputRows").get().value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)
    assert read[True][0] == read[False][0] and read[False][1] == 200_000
    assert read[True][1] <= 60_000


def test_curve_codes_of_any_point(spark):
    df = spark.createDataFrame([(-5.5, 3.0), (1e300, -1e300), (0.0, 0.0), (None, 1.0), (float("nan"), 1.0)], "x double, y double")
    codes = [r[0] for r in df.select(g.curve_code(F.col("x"), F.col("y"))).collect()]
    assert all(c >= 0 for c in codes[:3]) and len(set(codes[:3])) == 3


def test_ordered_result(spark, tmp_path):
    rows = [(i * 7919 % 1000, f"d{i % 3},{i}", i / 4) for i in range(1000)] + [(None, "x", 1.0), (5, None, None)]
    df = spark.createDataFrame(rows, "origin long, destination string, distance double").repartition(5)
    path = str(tmp_path / "o.csv")
    g.write_result_csv(df, path, ordered=True)
    back = sorted(tuple(r) for r in g.read_ordered_csv(spark, path).collect())
    assert [r[0] for r in back] == list(range(1, 1003))
    key = lambda r: (r[0] is None, r[0] or 0, r[2] is None, r[2] or 0, r[1] or "")
    assert [r[1:] for r in back] == sorted(rows, key=key)
    with pytest.raises(ValueError):
        g.write_result_csv(df, path, decimals=2, ordered=True)


def test_null_origins_in_comparisons(spark):
    a = spark.createDataFrame([(1, "a", 1.0), (None, "b", 1.0)], "origin long, destination string, distance double")
    assert g.check(a, a).count() == 0
    assert [r.agrees for r in g.compare_methods({"same": a}, a).collect()] == [True]
    assert g.check(a.where("origin = 1"), a).count() == 1


def test_bucketed_target_is_not_shuffled(spark, tmp_path):
    name = "keyed_test"
    spark.sql(f"drop table if exists {name}")
    rows = spark.range(1000).selectExpr("id as k", "id * 2 as v")
    try:
        g.create_keyed_table(spark, name, rows.schema, "k", 4, str(tmp_path / "keyed"))
        g.insert_into_keyed_table(spark, name, rows.where("k < 600"), "k", ["v"], 4)
        batch = rows.selectExpr("k", "v + 1 as v").unionByName(rows.selectExpr("k", "v + 2 as v"))
        plan = g.keys_to_insert(spark, name, batch, "k", ["v"], 4)._jdf.queryExecution().executedPlan().toString()
        # The one exchange is the batch's; the table is read in its buckets.
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan and "BroadcastExchange" not in plan
        g.insert_into_keyed_table(spark, name, batch, "k", ["v"], 4)
        assert sorted(map(tuple, spark.table(name).collect())) == [(k, 2 * k if k < 600 else 2 * k + 1) for k in range(1000)]
        with pytest.raises(Exception, match="k is NULL"):
            g.insert_into_keyed_table(spark, name, rows.selectExpr("cast(null as bigint) as k", "v"), "k", ["v"], 4)
    finally:
        spark.sql(f"drop table if exists {name}")
