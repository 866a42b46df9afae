
from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import fixtures as fx  # noqa: E402
import geonear as g  # noqa: E402
from geonear.functions.geometry import srid_of  # noqa: E402
from geonear.functions.hexgrid import RES9_EDGE, disk_reach  # noqa: E402
from geonear.plans.prepare import POSTCODE_SCHEMA, PROPERTY_SCHEMA  # noqa: E402
from geonear.session import scratch_path  # noqa: E402

# The corpus operators may be left out of an installation; a fault in them is an error.
_HERE = os.path.dirname(os.path.abspath(__file__))
if all(os.path.exists(os.path.join(_HERE, *p)) for p in (("corpus_pipeline.py",), ("geonear", "llm", "queries.py"))):
    import corpus_pipeline  # noqa: E402
    from geonear.llm import queries as corpus  # noqa: E402
else:
    corpus = None

R = 5000.0  # the distance cap of the workload, inclusive


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: nearest destination within the cap for every origin."""
    return knn_pyramid(spark, "/root/testdata/sf0.001")


def _both(spark, sf_dir, coarse=False):
    return fx.origins(spark, sf_dir, coarse), fx.destinations(spark, sf_dir, coarse)


# --- nearest neighbours -------------------------------------------------------


def knn_pyramid(spark, sf_dir):
    return g.nearest(*_both(spark, sf_dir), max_distance=R, round_to=2)


def knn_distinct_on(spark, sf_dir):
    return g.nearest_distinct_on(*_both(spark, sf_dir), R)


def knn_window(spark, sf_dir):
    return g.nearest_by_window(*_both(spark, sf_dir), R)


def knn_lateral(spark, sf_dir):
    return g.nearest_lateral(*_both(spark, sf_dir), R)


def knn_first_per_origin(spark, sf_dir):
    return g.nearest_sort_dedupe(*_both(spark, sf_dir), R)


def knn_bbox(spark, sf_dir):
    return g.nearest_in_square(*_both(spark, sf_dir), R)


def knn_unbounded(spark, sf_dir):
    return g.nearest(*_both(spark, sf_dir))


def knn_brute(spark, sf_dir):
    return g.nearest_all_vs_all(*_both(spark, sf_dir))


def knn_join_k5(spark, sf_dir):
    return g.knn_join(*_both(spark, sf_dir), k=5)


def knn_join_k10(spark, sf_dir):
    return g.knn_join(*_both(spark, sf_dir), k=10)


def knn_join_k10_top1(spark, sf_dir):
    return g.knn_join_top1(*_both(spark, sf_dir), k=10)


def knn_join_k100_top1(spark, sf_dir):
    return g.knn_join_top1(*_both(spark, sf_dir), k=100)


def knn_k5_rounded(spark, sf_dir):
    return g.knn_rounded_first(*_both(spark, sf_dir), k=5, digits=2)


def knn_left_unmatched(spark, sf_dir):
    return g.nearest(*_both(spark, sf_dir), max_distance=1000.0, how="left")


def nearest_all_ties(spark, sf_dir):
    return g.nearest_all_ties(*_both(spark, sf_dir, coarse=True), R)


def knn_nearest_first(spark, sf_dir):
    return g.nearest_first_of_ties(*_both(spark, sf_dir, coarse=True), R)


def knn_geodesic(spark, sf_dir):
    return g.nearest_geodesic(*_both(spark, sf_dir), R)


def knn_hex(spark, sf_dir):
    return g.nearest_in_hex_disk(*_both(spark, sf_dir), R)


def hex_cell(spark, sf_dir):
    cell = g.hex_cell(F.col("x"), F.col("y"), RES9_EDGE)
    points = fx.origins(spark, sf_dir).select("origin", cell.alias("cell"))
    return points.select("origin", "cell.q", "cell.r")


def hex_disk(spark, sf_dir):
    cell = g.hex_cell(F.col("x"), F.col("y"), RES9_EDGE)
    points = fx.destinations(spark, sf_dir)
    return points.select("destination", F.inline(g.hex_disk(cell, 5)))


# --- other joins and grouping ---------------------------------------------------


def join_dwithin_pairs(spark, sf_dir):
    return g.dwithin_join(*_both(spark, sf_dir), R)


def join_bbox_pairs(spark, sf_dir):
    return g.bbox_join(*_both(spark, sf_dir), 1000.0)


def join_point_in_polygon(spark, sf_dir):
    return g.points_in_polygons(fx.origins(spark, sf_dir), fx.edges(spark))


def agg_group_colocated(spark, sf_dir):
    return g.group_colocated(fx.raw_destinations(spark, sf_dir))


def _orders(spark, sf_dir):
    return fx.spread(fx.table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus"))


def agg_first_per_key(spark, sf_dir):
    return g.first_per_key(_orders(spark, sf_dir), ["o_custkey"], ["o_totalprice", "o_orderkey"])


def agg_last_per_key(spark, sf_dir):
    return g.last_per_key(_orders(spark, sf_dir), ["o_custkey"], ["o_orderkey"])


# --- scalars ---------------------------------------------------------------------


def geom_point_xy(spark, sf_dir):
    made = fx.origins(spark, sf_dir).select("origin", g.point(F.col("x"), F.col("y")).alias("geom"))
    made = g.with_srid(made, "geom", 27700)
    return made.select("origin", "geom.x", "geom.y", F.lit(srid_of(made, "geom")).alias("srid"))


def _order_to_customer(spark, sf_dir):
    """Each order's point beside the point of its customer."""
    orders = fx.table(spark, sf_dir, "orders").selectExpr(
        "o_custkey", "o_orderkey as origin",
        *fx._lattice("o_orderkey", 7919, 104729).replace(" as x", " as ax").replace(" as y", " as ay").split(", "),
    )
    customers = fx.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        *fx._lattice("(c_custkey div 3)", 6151, 7307).replace(" as x", " as bx").replace(" as y", " as by").split(", "),
    )
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))


def geom_distance(spark, sf_dir):
    xy = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    return _order_to_customer(spark, sf_dir).select(
        "origin", g.distance(*xy).alias("distance"), g.distance_sq(*xy).alias("distance_sq"),
        g.dwithin(*xy, R).alias("within"), g.bbox_within(*xy, R).alias("in_box"),
    )


def geom_geodesic(spark, sf_dir):
    degrees = [
        F.col(c) / 100000.0 - (0.0 if c[1] == "y" else 6.0) + (49.0 if c[1] == "y" else 0.0)
        for c in ("ay", "ax", "by", "bx")
    ]
    return _order_to_customer(spark, sf_dir).select(
        "origin",
        F.round(g.geodesic_distance(*degrees), 2).alias("sphere"),
        F.round(g.geodesic_distance(*degrees, spheroid=True), 2).alias("spheroid"),
        F.round(g.geodesic_inverse(*degrees), 2).alias("geodesic"),
    )


def geom_transform(spark, sf_dir):
    moved = g.reproject_points(fx.origins(spark, sf_dir))
    return moved.select("origin", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


def geom_wkt_roundtrip(spark, sf_dir):
    text = g.encode_wkt(fx.origins(spark, sf_dir)).select("origin", "wkt")
    return g.decode_wkt(text)


def geom_wkb_roundtrip(spark, sf_dir):
    coded = g.encode_wkb(fx.origins(spark, sf_dir), "wkb", as_hex=True).select("origin", "wkb")
    return g.decode_wkb(coded).select("origin", F.length("wkb").alias("hex_digits"), "x", "y")


def udf_sql_functions(spark, sf_dir):
    g.register_sql_functions(spark)
    origins, destinations = _both(spark, sf_dir)
    return spark.sql(
        """
        WITH a AS (SELECT *, st_point(x, y) AS geom FROM {origins}),
        b AS (SELECT *, st_point(bx, by) AS geom FROM {candidates}),
        knn AS (
            SELECT a.origin, b.destination, round(st_distance(a.geom, b.geom), 2) AS distance,
                   row_number() OVER (PARTITION BY a.origin
                       ORDER BY st_distance(a.geom, b.geom), b.destination) AS rn
            FROM a JOIN b ON a.x = b.x AND a.y = b.y
            WHERE st_dwithin(a.geom, b.geom, {cap}))
        SELECT * EXCEPT (rn) FROM knn WHERE rn = 1
        """,
        origins=origins, candidates=g.candidate_places(origins, destinations, R), cap=R,
    )


def udf_hex_lateral(spark, sf_dir):
    """The hexagon-limited search as SQL text; the disk is a table function beside the cells that need it.

    A nearest destination that lies in the disk is the answer. Pairs by cells are for the origins
    whose nearest is outside their disk, but not beyond its reach.
    """
    g.register_sql_functions(spark)
    origins, destinations = _both(spark, sf_dir)
    lists = g.neighbour_lists(origins, destinations, 1, R)
    nearest = g.materialize(lists.select("origin", "x", "y", F.inline_outer("nearest")), "hex-lateral")
    return spark.sql(
        """
        WITH n AS (SELECT origin, destination, st_point(x, y) AS geom, st_point(bx, by) AS near,
                          hex_cell(x, y, {edge}) AS cell, hex_cell(bx, by, {edge}) AS near_cell FROM {nearest}),
        a AS (SELECT origin, geom, cell FROM n
              WHERE hex_steps(cell, near_cell) > 5 AND st_distance(geom, near) <= {reach}),
        c AS (SELECT destination, st_point(x, y) AS geom, hex_cell(x, y, {edge}) AS cell FROM {destinations}),
        d AS (SELECT w.cell, k.q, k.r FROM (SELECT DISTINCT cell FROM a) w, LATERAL hex_disk(w.cell, 5) k),
        b AS (SELECT d.cell, c.destination, c.geom FROM d JOIN c ON c.cell.q = d.q AND c.cell.r = d.r),
        pairs AS (
            SELECT origin, destination, st_distance(geom, near) AS exact FROM n WHERE hex_steps(cell, near_cell) <= 5
            UNION ALL
            SELECT a.origin, b.destination, st_distance(a.geom, b.geom) FROM a JOIN b ON a.cell = b.cell
            WHERE st_dwithin(a.geom, b.geom, {cap})),
        knn AS (
            SELECT origin, destination, round(exact, 2) AS distance,
                   row_number() OVER (PARTITION BY origin ORDER BY exact, destination) AS rn
            FROM pairs)
        SELECT * EXCEPT (rn) FROM knn WHERE rn = 1
        """,
        nearest=nearest, destinations=destinations, edge=RES9_EDGE, reach=disk_reach(RES9_EDGE, 5), cap=R)


def udf_wkb_srid(spark, sf_dir):
    g.register_sql_functions(spark)
    return spark.sql(
        """
        SELECT origin, st_srid_of(st_set_srid(st_plain(p), 27700)) AS srid, st_x(st_plain(p)) AS x, p.y AS y, length(w) AS bytes
        FROM (SELECT origin, w, st_pointfromwkb(w) AS p FROM (SELECT origin, st_aswkb(st_point(x, y)) AS w FROM {origins}))
        """, origins=fx.origins(spark, sf_dir))


# --- sources and sinks -------------------------------------------------------------


def src_csv_header(spark, sf_dir):
    path = scratch_path(spark, "csv")
    _raw_properties(spark, sf_dir).write.option("header", True).csv(path)
    return g.read_points_csv(spark, path).withColumns(
        {c: F.col(c).cast("double") for c in ("LATITUDE", "LONGITUDE")})


def src_csv_pipe(spark, sf_dir):
    path = scratch_path(spark, "psv")
    g.export_points_psv(fx.destinations(spark, sf_dir), path)
    read = g.read_points_psv(spark, path, "x0 double, y0 double, postcode string, wkt string")
    return g.decode_wkt(read).select("postcode", "x0", "y0", "wkt", "x", "y")


def src_orc_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "orc")
    g.write_points_orc(fx.origins(spark, sf_dir), path)
    return g.decode_wkb(g.read_points_orc(spark, path).drop("x", "y"), "geom_wkb").select(
        "origin", "x", "y")


def src_geopackage(spark, sf_dir):
    folder = fx.write_geopackages(fx.raw_destinations(spark, sf_dir), "codepoint")
    layer = g.read_geopackage(spark, folder, "codepoint", rows_per_partition=1000)
    return g.decode_wkb(layer, "wkb").select("postcode", "srs_id", "x", "y")


def src_orc_clustered(spark, sf_dir):
    """Points of one box from files written along a curve."""
    path = scratch_path(spark, "orc")
    g.write_points_orc(fx.origins(spark, sf_dir), path, clustered=True)
    return g.read_points_orc(spark, path).where("x between 430000 and 432000 and y between 190000 and 193000").select(
        "origin", "x", "y")


def src_geopackage_filter(spark, sf_dir):
    """Rows of a layer by attribute; the comparison is answered inside the files."""
    folder = fx.write_geopackages(fx.raw_destinations(spark, sf_dir), "codepoint")
    layer = g.read_geopackage(spark, folder, "codepoint", where=[("postcode", ">=", "Customer#000000100")])
    return g.decode_wkb(layer, "wkb").select("postcode", "x", "y")


def sink_ordered_result(spark, sf_dir):
    """A result written in order over all files, read back with each row's position."""
    path = scratch_path(spark, "result")
    g.write_result_csv(knn_pyramid(spark, sf_dir), path, ordered=True)
    return g.read_ordered_csv(spark, path)


def src_copy_by_name(spark, sf_dir):
    path = scratch_path(spark, "copy")
    fx.origins(spark, sf_dir).selectExpr("y as Y", "cast(origin as int) as ORIGIN", "x as X",
                                         "'unused' as extra").write.orc(path)
    target = spark.createDataFrame([], "origin bigint, x double, y double")
    return g.append_by_name(g.read_points_orc(spark, path, glob="*.orc"), target)


def sink_result_csv(spark, sf_dir):
    path = scratch_path(spark, "result")
    g.write_result_csv(knn_pyramid(spark, sf_dir), path)
    return g.read_result_csv(spark, path)


def sink_table_ctas(spark, sf_dir):
    name = f"knn_result_{uuid.uuid4().hex}"
    g.save_result_table(knn_pyramid(spark, sf_dir), name, scratch_path(spark, "table"))
    return spark.table(name)


def sink_insert_new_keys(spark, sf_dir):
    path = scratch_path(spark, "target")
    orders = _orders(spark, sf_dir)
    first = g.first_per_key(orders.where("o_orderstatus = 'F'"), ["o_custkey"], ["o_totalprice", "o_orderkey"])
    first.write.orc(path)
    g.insert_new_keys(spark, path, orders, "o_custkey", ["o_orderkey"])
    return spark.read.orc(path)


def sink_insert_bucketed(spark, sf_dir):
    """Two loads into a table bucketed by its key: the second adds unknown keys only."""
    name, orders = f"keyed_{uuid.uuid4().hex}", _orders(spark, sf_dir)
    g.create_keyed_table(spark, name, orders.schema, "o_custkey", 8, scratch_path(spark, "keyed"))
    for batch in (orders.where("o_orderstatus = 'F'"), orders):
        order = ["o_totalprice", "o_orderkey"] if batch is not orders else ["o_orderkey"]
        g.insert_into_keyed_table(spark, name, batch, "o_custkey", order, 8)
    return spark.table(name)


# --- jobs ----------------------------------------------------------------------------


def _raw_properties(spark, sf_dir):
    return fx.origins(spark, sf_dir).selectExpr(
        "cast(origin as string) as UPRN", "x as X_COORDINATE", "y as Y_COORDINATE",
        "cast(y / 100000.0D as string) as LATITUDE", "cast(x / 100000.0D as string) as LONGITUDE",
    )


def _prepared(spark, sf_dir):
    """The preparation from its three input files: a CSV, a point layer and a polygon layer."""
    csv = scratch_path(spark, "csv")
    _raw_properties(spark, sf_dir).write.option("header", True).csv(csv)
    points = fx.write_geopackages(fx.raw_destinations(spark, sf_dir), "codepoint")
    postcodes = g.decode_wkb(g.read_geopackage(spark, points, "codepoint"), "wkb").select("postcode", "x", "y")
    districts = g.polygon_edges(g.read_geopackage(spark, fx.write_districts(spark, "district"), "district"))
    return g.prepare(g.read_points_csv(spark, csv), postcodes, districts, "Alpha", scratch_path(spark, "prepared"))


def prep_job(spark, sf_dir):
    origins, destinations = (g.read_points_orc(spark, p) for p in _prepared(spark, sf_dir))
    parts = [
        g.decode_wkb(df.drop("x", "y"), "geom_wkb").selectExpr(f"'{kind}' as kind", f"{key} as id", "x", "y")
        for kind, key, df in (("origin", "UPRN", origins), ("destination", "postcode", destinations))
    ]
    return parts[0].unionByName(parts[1])


def load_job(spark, sf_dir):
    prepared = _prepared(spark, sf_dir)
    folder, parts = scratch_path(spark, "serving"), []
    for kind, orc, key, schema in zip(("origin", "destination"), prepared, ("uprn", "postcode"),
                                      (PROPERTY_SCHEMA, POSTCODE_SCHEMA)):
        # The second load finds every key present and adds nothing.
        g.load_serving_table(spark, orc, f"{folder}/{kind}", key, schema)
        loaded = g.load_serving_table(spark, orc, f"{folder}/{kind}", key, schema)
        more = ["lat", "lon"] if kind == "origin" else ["cast(null as double) as lat", "cast(null as double) as lon"]
        parts.append(loaded.selectExpr(f"'{kind}' as kind", f"cast({key} as string) as id", "geom.x as x",
                                       "geom.y as y", *more, "wkt"))
    return parts[0].unionByName(parts[1])


def _hex_and_reference(spark, sf_dir):
    both = _both(spark, sf_dir)
    return g.nearest_in_hex_disk(*both, R), g.nearest_distinct_on(*both, R)


def compare_inner(spark, sf_dir):
    hexed, reference = _hex_and_reference(spark, sf_dir)
    return g.diff_inner(reference, hexed)


def compare_outer(spark, sf_dir):
    return g.check(*_hex_and_reference(spark, sf_dir))


def compare_methods_report(spark, sf_dir):
    """Methods that rank pairs share them, methods of k=1 the leaves; answers are compared by numbers of keys."""
    origins, destinations = _both(spark, sf_dir)
    destinations = g.materialize(g.number_keys(destinations)[0], "numbered")
    both, leaves = (origins, destinations), g.build_leaves(destinations)
    capped = g.materialize(g.candidate_pairs(*both, R, leaves=leaves), "capped-pairs")
    free = g.materialize(g.candidate_pairs(*both, leaves=leaves), "free-pairs")
    results = {
        "knn_window": g.nearest_by_window(*both, R, pairs=capped),
        "knn_lateral": g.nearest_lateral(*both, R, leaves=leaves),
        "knn_first_per_origin": g.nearest_sort_dedupe(*both, R, pairs=capped),
        "knn_pyramid": g.nearest(*both, R, leaves=leaves),
        "knn_bbox": g.nearest_in_square(*both, R, leaves=leaves),
        "knn_hex": g.nearest_in_hex_disk(*both, R, leaves=leaves),
        "knn_unbounded": g.nearest(*both, leaves=leaves),
        "knn_brute": g.nearest_all_vs_all(*both, pairs=free),
        "knn_join_k10_top1": g.knn_join_top1(*both, 10),
        "knn_join_k100_top1": g.knn_join_top1(*both, 100),
        "knn_k5_rounded": g.knn_rounded_first(*both, 5),
        "knn_nearest_first": g.nearest_first_of_ties(*both, R),
        "knn_geodesic": g.nearest_geodesic(*both, R, leaves=leaves),
    }
    return g.compare_methods(results, g.nearest_distinct_on(*both, R, pairs=capped))


_ALL = (
    agg_first_per_key, agg_group_colocated, agg_last_per_key, compare_inner,
    compare_methods_report, compare_outer, geom_distance, geom_geodesic, geom_point_xy,
    geom_transform, geom_wkb_roundtrip, geom_wkt_roundtrip, hex_cell, hex_disk, join_bbox_pairs,
    join_dwithin_pairs, join_point_in_polygon, knn_bbox, knn_brute, knn_distinct_on,
    knn_first_per_origin, knn_geodesic, knn_hex, knn_join_k10, knn_join_k100_top1, knn_join_k10_top1,
    knn_join_k5, knn_k5_rounded, knn_lateral, knn_left_unmatched, knn_nearest_first, knn_pyramid,
    knn_unbounded, knn_window, load_job, nearest_all_ties, prep_job, sink_insert_new_keys,
    sink_insert_bucketed, sink_ordered_result, sink_result_csv, sink_table_ctas, src_copy_by_name, src_csv_header, src_csv_pipe,
    src_geopackage, src_geopackage_filter, src_orc_clustered, src_orc_roundtrip, udf_hex_lateral, udf_sql_functions,
    udf_wkb_srid,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {q.__name__: q for q in _ALL}
    return own if corpus is None else own | corpus.QUERIES | {"pipeline": corpus_pipeline.run}


# --- DuckDB equivalents -----------------------------------------------------------------


def _geodesic_steps(source: str) -> str:
    """CTEs from ``source(a, o, b, p, …)``, radians, to ``r`` for :data:`SPHERE` and :data:`SPHEROID`."""
    return f"""
q as (select *, (a + b) / 2 as f, (a - b) / 2 as g, (o - p) / 2 as l from ({source})),
s as (select *, pow(sin(g), 2) * pow(cos(l), 2) + pow(cos(f), 2) * pow(sin(l), 2) as s,
             pow(cos(g), 2) * pow(cos(l), 2) + pow(sin(f), 2) * pow(sin(l), 2) as c,
             pow(sin((b - a) / 2), 2) + cos(a) * cos(b) * pow(sin((p - o) / 2), 2) as h from q),
w as (select *, atan(sqrt(s / c)) as w from s),
r as (select *, case when w <> 0 then sqrt(s * c) / w end as r from w)"""


SPHERE = "2 * 6371008.8e0 * asin(sqrt(h))"
SPHEROID = """case when s = 0 then 0e0 else 2 * w * 6378137e0 * (1 + (1 / 298.257223563e0) * (
        (3 * r - 1) / (2 * c) * pow(sin(f), 2) * pow(cos(g), 2)
        - (3 * r + 1) / (2 * s) * pow(cos(f), 2) * pow(sin(g), 2))) end"""


def _sql_geodesic() -> str:
    return f"""
with d as (select o_orderkey as origin, o_custkey,
    radians(cast(180000 + 10 * ((o_orderkey * 104729) % 3001) as double) / 1e5 - 0e0 + 49e0) as a,
    radians(cast(420000 + 10 * ((o_orderkey * 7919) % 4001) as double) / 1e5 - 6e0 + 0e0) as o
    from orders),
e as (select c_custkey,
    radians(cast(180000 + 10 * (((c_custkey // 3) * 7307) % 3001) as double) / 1e5 - 0e0 + 49e0) as b,
    radians(cast(420000 + 10 * (((c_custkey // 3) * 6151) % 4001) as double) / 1e5 - 6e0 + 0e0) as p
    from customer),
{_geodesic_steps("select origin, a, o, b, p from d join e on o_custkey = c_custkey")}
, {_inverse_steps("r")}
select origin, round({SPHERE}, 2) as sphere, round({SPHEROID}, 2) as spheroid, round(length, 2) as geodesic from inverse"""


def _inverse_steps(source: str, rounds: int = 9) -> str:
    """CTEs from ``source`` with ``a, o, b, p`` in radians to ``inverse`` with ``length``: a fixed number of rounds."""
    f = "(1 / 298.257223563e0)"
    steps = [f"""i0 as (select *, atan((1 - {f}) * tan(a)) as u1, atan((1 - {f}) * tan(b)) as u2, p - o as lam
        from {source})"""]
    for i in range(rounds):
        last = ", cs as cs1, ss as ss1, sg as sg1, ca as ca1, cm as cm1" if i == rounds - 1 else ""
        steps.append(f"""j{i} as (select *, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) as cs,
            sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) as ss from i{i}),
        k{i} as (select *, atan2(ss, cs) as sg, case when ss > 0 then cos(u1) * cos(u2) * sin(lam) / ss else 0e0 end as sa from j{i}),
        l{i} as (select *, 1 - sa * sa as ca, case when 1 - sa * sa > 1e-15 then cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa)
            else 0e0 end as cm from k{i}),
        m{i} as (select *, {f} / 16 * ca * (4 + {f} * (4 - 3 * ca)) as kk from l{i}),
        i{i + 1} as (select * exclude (lam, cs, ss, sg, sa, ca, cm, kk), p - o + (1 - kk) * {f} * sa
            * (sg + kk * ss * (cm + kk * cs * (2 * cm * cm - 1))) as lam{last} from m{i})""")
    steps.append(f"""uu as (select *, ca1 * (1 / pow(1 - {f}, 2) - 1) as u from i{rounds}),
        xy as (select *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) as xx,
            u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) as yy from uu),
        inverse as (select *, 6378137e0 * (1 - {f}) * xx * (sg1 - yy * ss1 * (cm1 + yy / 4 * (cs1 * (2 * cm1 * cm1 - 1)
            - yy / 6 * cm1 * (4 * ss1 * ss1 - 3) * (4 * cm1 * cm1 - 3)))) as length from xy)""")
    return ",\n".join(steps)


def _sql_nearest_geodesic() -> tuple[str, ...]:
    """CTEs up to ``geodesic``: every pair on the sphere, the nearest on the spheroid."""
    globe = {}
    for side, key in (("origins", "origin"), ("destinations", "destination")):
        globe[side] = _sql_degrees(f"select {key}, x, y from {side}")
    return (
        f"globe_a as materialized (select origin, radians(lat) as a, radians(lon) as o from ({globe['origins']}))",
        f"globe_b as materialized (select destination, radians(lat) as b, radians(lon) as p"
        f" from ({globe['destinations']}))",
        _geodesic_steps("select * from globe_a, globe_b").strip(),
        f"""geodesic as (select origin, destination, round({SPHEROID}, 2) as distance
            from (select *, {SPHERE} as sphere from r) where sphere <= {R}
            qualify row_number() over (partition by origin order by sphere, destination) = 1)""",
    )


def _sql_degrees(points: str) -> str:
    """``points`` (a query with x, y) with lat and lon."""
    a, b, f0 = "6377563.396e0", "6356256.909e0", "0.9996012717e0"
    e2 = f"(1 - ({b} / {a}) * ({b} / {a}))"
    n = f"(({a} - {b}) / ({a} + {b}))"
    p0 = "radians(49e0)"
    body = f"select *, x - 400000e0 as d, y + 100000e0 as north from ({points})"
    count = 0

    def step(name, value):
        nonlocal body, count
        count += 1
        body = f"select *, {value} as {name} from ({body}) t{count}"

    step("p0", f"north / ({a} * {f0}) + {p0}")
    for i in range(4):
        p = f"p{i}"
        arc = (
            f"{b} * {f0} * ((1 + {n} + 1.25e0 * pow({n}, 2) + 1.25e0 * pow({n}, 3)) * ({p} - {p0})"
            f" - (3 * {n} + 3 * pow({n}, 2) + 2.625e0 * pow({n}, 3)) * sin({p} - {p0}) * cos({p} + {p0})"
            f" + (1.875e0 * pow({n}, 2) + 1.875e0 * pow({n}, 3)) * sin(2 * ({p} - {p0})) * cos(2 * ({p} + {p0}))"
            f" - (35e0 / 24e0 * pow({n}, 3)) * sin(3 * ({p} - {p0})) * cos(3 * ({p} + {p0})))"
        )
        step(f"p{i + 1}", f"{p} + (north - {arc}) / ({a} * {f0})")
    step("nu", f"{a} * {f0} / sqrt(1 - {e2} * pow(sin(p4), 2))")
    step("rho", f"nu * (1 - {e2}) / (1 - {e2} * pow(sin(p4), 2))")
    step("eta", "nu / rho - 1")
    step("t", "tan(p4)")
    step("lat1", """p4 - t / (2 * rho * nu) * pow(d, 2)
        + t / (24 * rho * pow(nu, 3)) * (5 + 3 * pow(t, 2) + eta - 9 * pow(t, 2) * eta) * pow(d, 4)
        - t / (720 * rho * pow(nu, 5)) * (61 + 90 * pow(t, 2) + 45 * pow(t, 4)) * pow(d, 6)""")
    step("lon1", """radians(-2e0) + (1 / cos(p4)) / nu * d
        - (1 / cos(p4)) / (6 * pow(nu, 3)) * (nu / rho + 2 * pow(t, 2)) * pow(d, 3)
        + (1 / cos(p4)) / (120 * pow(nu, 5)) * (5 + 28 * pow(t, 2) + 24 * pow(t, 4)) * pow(d, 5)
        - (1 / cos(p4)) / (5040 * pow(nu, 7))
            * (61 + 662 * pow(t, 2) + 1320 * pow(t, 4) + 720 * pow(t, 6)) * pow(d, 7)""")
    step("v", f"{a} / sqrt(1 - {e2} * pow(sin(lat1), 2))")
    step("cx", "v * cos(lat1) * cos(lon1)")
    step("cy", "v * cos(lat1) * sin(lon1)")
    step("cz", f"(1 - {e2}) * v * sin(lat1)")
    m = "(1 - 20.4894e-6)"
    rx, ry, rz = (f"radians({v}e0 / 3600e0)" for v in ("0.1502", "0.2470", "0.8421"))
    step("wx", f"446.448e0 + {m} * cx - {rz} * cy + {ry} * cz")
    step("wy", f"-125.157e0 + {rz} * cx + {m} * cy - {rx} * cz")
    step("wz", f"542.060e0 - {ry} * cx + {rx} * cy + {m} * cz")
    w2 = "((1 / 298.257223563e0) * (2 - 1 / 298.257223563e0))"
    step("q0", f"atan2(wz, sqrt(wx * wx + wy * wy) * (1 - {w2}))")
    for i in range(4):
        step(f"q{i + 1}", f"atan2(wz + {w2} * 6378137e0 / sqrt(1 - {w2} * pow(sin(q{i}), 2)) * sin(q{i}),"
                          " sqrt(wx * wx + wy * wy))")
    return f"select *, degrees(q4) as lat, degrees(atan2(wy, wx)) as lon from ({body}) done"


def _sql_transform() -> str:
    moved = _sql_degrees("select origin, x, y from origins")
    return fx.sql(f"select origin, round(lat, 7) as lat, round(lon, 7) as lon from ({moved})")


def oracle_sql() -> dict[str, str]:
    near = fx.sql_nearest
    capped, free = near(f"distance <= {R}"), near()
    rounded = f"select origin, destination, round(distance, 2) as distance from ({capped})"
    square = near(f"abs(dx) <= {R} and abs(dy) <= {R}")
    k5_rounded = (
        "select origin, destination, round(distance, 2) as distance from "
        f"({near(k=5)}) qualify row_number() over "
        "(partition by origin order by round(distance, 2), destination) = 1"
    )
    hexed = (
        f"hex_a as materialized (select *, {fx.sql_hex('x', 'y', RES9_EDGE)} as cell from origins)",
        f"hex_b as materialized (select *, {fx.sql_hex('x', 'y', RES9_EDGE)} as cell from destinations)",
        """hex_pairs as (select p.* from pairs p join hex_a a using (origin)
            join hex_b b using (destination)
            where greatest(abs(a.cell.q - b.cell.q), abs(a.cell.r - b.cell.r),
                abs(a.cell.q - b.cell.q + a.cell.r - b.cell.r)) <= 5)""",
        f"""hex_knn as (select origin, destination, round(distance, 2) as distance from hex_pairs
            where distance <= {R} qualify row_number() over (
                partition by origin order by distance, destination) = 1)""",
    )
    reference = f"reference as ({rounded})"
    ties = f"""select origin, destination, distance from pairs where distance <= {R}
        qualify distance = min(distance) over (partition by origin)"""
    first_f = """select o_custkey, o_orderkey, o_totalprice, o_orderstatus from orders
        where o_orderstatus = 'F' qualify row_number() over (
            partition by o_custkey order by o_totalprice, o_orderkey) = 1"""
    property_rows = ("inside as (select i.origin, i.x, i.y from "
                     f"({fx.sql_inside('origins', 'origin')}) i where name = 'Alpha')")
    methods = {
        "knn_window": capped, "knn_lateral": capped, "knn_first_per_origin": capped,
        "knn_pyramid": capped, "knn_bbox": square, "knn_hex": "select * from hex_knn",
        "knn_unbounded": free, "knn_brute": free, "knn_join_k10_top1": free,
        "knn_join_k100_top1": free, "knn_k5_rounded": k5_rounded, "knn_nearest_first": capped,
        "knn_geodesic": "select * from geodesic",
    }
    report = " union all ".join(
        f"""select '{m}' as method, count(b.origin) as n_rows,
            cast(count(*) filter (where not coalesce(a.destination = b.destination, false))
                as bigint) as n_mismatch,
            count(*) filter (where not coalesce(a.destination = b.destination, false)) = 0 as agrees
        from reference a full outer join ({q}) b on a.origin = b.origin"""
        for m, q in methods.items()
    )
    order_customer = f"""
        from (select o_orderkey as origin, o_custkey, {fx._lattice('o_orderkey', 7919, 104729)} from orders) a
        join (select c_custkey, {fx._lattice('(c_custkey // 3)', 6151, 7307)} from customer) b
        on o_custkey = c_custkey"""
    sq = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
    point_rows = "select origin, x, y from origins"
    own = {
        "agg_first_per_key": """select o_custkey, o_orderkey, o_totalprice, o_orderstatus from orders
            qualify row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) = 1""",
        "agg_last_per_key": """select o_custkey, o_orderkey, o_totalprice, o_orderstatus from orders
            qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1""",
        "agg_group_colocated": fx.sql("select x, y, destination from destinations"),
        "compare_inner": fx.sql(
            """select a.origin, a.destination as left_destination, a.distance as left_distance,
                b.destination as right_destination, b.distance as right_distance
            from reference a join hex_knn b using (origin) where a.destination <> b.destination""",
            *hexed, reference),
        "compare_outer": fx.sql(
            """select coalesce(a.origin, b.origin) as origin, a.destination as destination_x,
                a.distance as distance_x, b.destination as destination_y, b.distance as distance_y
            from reference a full outer join hex_knn b on a.origin = b.origin
            where not coalesce(a.destination = b.destination, false)""",
            *hexed, reference),
        "compare_methods_report": fx.sql(report, *hexed, reference, *_sql_nearest_geodesic()),
        "geom_distance": f"""select origin, sqrt({sq}) as distance, {sq} as distance_sq,
            sqrt({sq}) <= {R} as within,
            abs(a.x - b.x) <= {R} and abs(a.y - b.y) <= {R} as in_box {order_customer}""",
        "geom_geodesic": _sql_geodesic(),
        "geom_point_xy": fx.sql("select origin, x, y, 27700 as srid from origins"),
        "geom_transform": _sql_transform(),
        "geom_wkb_roundtrip": fx.sql("select origin, 42 as hex_digits, x, y from origins"),
        "geom_wkt_roundtrip": fx.sql(
            "select origin, 'POINT(' || x || ' ' || y || ')' as wkt, x, y from origins"),
        "hex_cell": fx.sql("select origin, cell.q as q, cell.r as r from hex_a", hexed[0]),
        "hex_disk": fx.sql(
            """select destination, cell.q + i as q, cell.r + j as r
            from hex_b, range(-5, 6) a(i), range(-5, 6) b(j) where abs(i + j) <= 5""", hexed[1]),
        "join_bbox_pairs": fx.sql("""select origin, destination, distance from pairs
            where abs(dx) <= 1000 and abs(dy) <= 1000"""),
        "join_dwithin_pairs": fx.sql(
            f"select origin, destination, distance from pairs where distance <= {R}"),
        "join_point_in_polygon": fx.sql(fx.sql_inside("origins", "origin"), fx.sql_edges()),
        "knn_bbox": fx.sql(square),
        "knn_brute": fx.sql(free),
        "knn_distinct_on": fx.sql(rounded),
        "knn_first_per_origin": fx.sql(capped),
        "knn_geodesic": fx.sql("select * from geodesic", *_sql_nearest_geodesic()),
        "knn_hex": fx.sql("select * from hex_knn", *hexed),
        "knn_join_k10": fx.sql(near(k=10)),
        "knn_join_k100_top1": fx.sql(f"select * from ({near(k=100)}) qualify row_number() over "
                                     "(partition by origin order by distance, destination) = 1"),
        "knn_join_k10_top1": fx.sql(f"select * from ({near(k=10)}) qualify row_number() over "
                                    "(partition by origin order by distance, destination) = 1"),
        "knn_join_k5": fx.sql(near(k=5)),
        "knn_k5_rounded": fx.sql(k5_rounded),
        "knn_lateral": fx.sql(rounded),
        "knn_left_unmatched": fx.sql(
            f"""select a.origin, b.destination, b.distance
            from origins a left join ({near('distance <= 1000')}) b on a.origin = b.origin"""),
        "knn_nearest_first": fx.sql(
            f"""select origin, min(destination) as destination, min(distance) as distance
            from ({ties}) group by origin""", coarse=True),
        "knn_pyramid": fx.sql(rounded),
        "knn_unbounded": fx.sql(free),
        "knn_window": fx.sql(rounded),
        "load_job": fx.sql(
            f"""select 'origin' as kind, cast(origin as varchar) as id, x, y, y / 1e5 as lat, x / 1e5 as lon,
                'POINT(' || x || ' ' || y || ')' as wkt from inside
            union all
            select 'destination', string_agg(destination, ',' order by destination), x, y, null, null,
                'POINT(' || x || ' ' || y || ')'
            from ({fx.sql_inside('raw_destinations', 'destination')}) where name = 'Alpha'
            group by x, y""",
            fx.sql_edges(), property_rows),
        "nearest_all_ties": fx.sql(ties, coarse=True),
        "prep_job": fx.sql(
            f"""select 'origin' as kind, cast(origin as varchar) as id, x, y from inside
            union all
            select 'destination', string_agg(destination, ',' order by destination), x, y
            from ({fx.sql_inside('raw_destinations', 'destination')}) where name = 'Alpha'
            group by x, y""",
            fx.sql_edges(), property_rows),
        "sink_insert_bucketed": f"""with target as ({first_f})
            select * from target union all
            (select o_custkey, o_orderkey, o_totalprice, o_orderstatus from orders
             where o_custkey not in (select o_custkey from target)
             qualify row_number() over (partition by o_custkey order by o_orderkey) = 1)""",
        "sink_insert_new_keys": f"""with target as ({first_f})
            select * from target union all
            select o_custkey, o_orderkey, o_totalprice, o_orderstatus from orders
            where o_custkey not in (select o_custkey from target)
            qualify row_number() over (partition by o_custkey order by o_orderkey) = 1""",
        "sink_result_csv": fx.sql(rounded),
        "sink_table_ctas": fx.sql(rounded),
        "src_copy_by_name": fx.sql(point_rows),
        "src_csv_header": fx.sql("""select cast(origin as varchar) as "UPRN",
            x as "X_COORDINATE", y as "Y_COORDINATE", y / 1e5 as "LATITUDE", x / 1e5 as "LONGITUDE"
            from origins"""),
        "src_csv_pipe": fx.sql("""select destination as postcode, x as x0, y as y0,
            'POINT(' || x || ' ' || y || ')' as wkt, x, y from destinations"""),
        "src_geopackage": fx.sql(
            "select destination as postcode, 27700 as srs_id, x, y from raw_destinations"),
        "src_geopackage_filter": fx.sql("select destination as postcode, x, y from raw_destinations where destination >= 'Customer#000000100'"),
        "src_orc_clustered": fx.sql(
            point_rows + " where x between 430000 and 432000 and y between 190000 and 193000"),
        "src_orc_roundtrip": fx.sql(point_rows),
        "sink_ordered_result": fx.sql(
            f"select row_number() over (order by origin) as position, origin, destination, distance from ({rounded})"),
        "udf_hex_lateral": fx.sql("select * from hex_knn", *hexed),
        "udf_wkb_srid": fx.sql("select origin, 27700 as srid, x, y, 21 as bytes from origins"),
        "udf_sql_functions": fx.sql(rounded),
    }
    return own if corpus is None else own | corpus.ORACLE_SQL
