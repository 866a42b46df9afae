"""The given tables seen as points, and the same views as DuckDB SQL.

Orders are origins, customers are postcodes (three per coordinate), on integer
lattices, so that Spark and DuckDB compute identical doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import geonear as g
from geonear.session import scratch_path

# Vertices of the two test districts: name, ring, then x and y in metres.
RINGS = (
    ("Alpha", 0, ((425000, 185000), (455000, 187000), (452000, 206000), (438000, 200000),
                  (426000, 207000))),
    ("Alpha", 1, ((436000, 190000), (444000, 190000), (444000, 195000), (436000, 195000))),
    ("Beta", 0, ((420000, 180000), (424000, 180000), (424000, 184000), (420000, 184000))),
)
VERTICES = [
    (name, ring, seq, float(x), float(y))
    for name, ring, points in RINGS
    for seq, (x, y) in enumerate(points)
]


def _lattice(v: str, dx: int, dy: int, step: int = 10, nx: int = 4001, ny: int = 3001) -> str:
    return (
        f"cast(420000 + {step} * (({v} * {dx}) % {nx}) as double) as x, "
        f"cast(180000 + {step} * (({v} * {dy}) % {ny}) as double) as y"
    )


def _coarse(v: str, dx: int, dy: int) -> str:
    """A 500 m lattice, on which many nearest destinations are tied."""
    return _lattice(v, dx, dy, 500, 81, 61)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores although the test files are too small to be split.

    Only for plain scans, where asking for the partition count runs nothing;
    a large table has enough splits and is left alone.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def origins(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    at = (_coarse if coarse else _lattice)("o_orderkey", 7919, 104729)
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey"))
    return orders.selectExpr("o_orderkey as origin", *at.split(", "))


def raw_destinations(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    at = (_coarse if coarse else _lattice)("(c_custkey div 3)", 6151, 7307)
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return customers.selectExpr("c_name as destination", *at.split(", "))


def destinations(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    return g.group_colocated(raw_destinations(spark, sf_dir, coarse))


def edges(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(VERTICES, "name string, ring int, seq int, x double, y double")
    return g.ring_edges(rows)


# --- DuckDB ------------------------------------------------------------------


def _views(coarse: bool) -> str:
    at = _coarse if coarse else _lattice
    return f"""
origins as (select o_orderkey as origin, {at('o_orderkey', 7919, 104729)} from orders),
raw_destinations as (
    select c_name as destination, {at('(c_custkey // 3)', 6151, 7307)} from customer),
destinations as (
    select string_agg(destination, ',' order by destination) as destination, x, y
    from raw_destinations group by x, y),
pairs as (
    select a.origin, b.destination, a.x - b.x as dx, a.y - b.y as dy,
           sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as distance
    from origins a, destinations b)"""


def sql(body: str, *more: str, coarse: bool = False) -> str:
    """A query over ``origins, raw_destinations, destinations, pairs`` and ``more``."""
    return "with " + ",\n".join([_views(coarse).strip(), *more]) + "\n" + body


def sql_nearest(where: str = "true", k: int = 1, order: str = "distance, destination") -> str:
    """Rows of ``pairs`` by brute force: the first ``k`` per origin."""
    return (
        f"select origin, destination, distance from pairs where {where} "
        f"qualify row_number() over (partition by origin order by {order}) <= {k}"
    )


def sql_edges() -> str:
    rows = []
    for name, _, points in RINGS:
        for a, b in zip(points, points[1:] + points[:1]):
            rows.append(f"('{name}', {a[0]}.0e0, {a[1]}.0e0, {b[0]}.0e0, {b[1]}.0e0)")
    return "edges(name, x1, y1, x2, y2) as (values " + ", ".join(rows) + ")"


def sql_inside(points: str, key: str) -> str:
    """Even-odd test of every point against every edge, boundary included."""
    return f"""
select {key}, x, y, name from (
    select p.{key}, p.x, p.y, e.name,
        sum(case when (e.y1 > p.y) <> (e.y2 > p.y) and
            ((e.x2 - e.x1) * (p.y - e.y1) - (e.y2 - e.y1) * (p.x - e.x1) < 0) = (e.y2 > e.y1)
            then 1 else 0 end) as crossings,
        bool_or((e.x2 - e.x1) * (p.y - e.y1) = (e.y2 - e.y1) * (p.x - e.x1)
            and p.x between least(e.x1, e.x2) and greatest(e.x1, e.x2)
            and p.y between least(e.y1, e.y2) and greatest(e.y1, e.y2)) as touching
    from {points} p, edges e group by all)
where crossings % 2 = 1 or touching"""


def sql_hex(x: str, y: str, edge: float) -> str:
    """``struct(q, r)`` of the hexagon of a point, as a subquery expression."""
    fq = f"((1.7320508075688772e0 / 3e0 * {x} - {y} / 3e0) / {edge!r}e0)"
    fr = f"(({y} * (2e0 / 3e0)) / {edge!r}e0)"
    return f"""(select {{'q': case when eq > er and eq > es then -r - t else q end,
        'r': case when not (eq > er and eq > es) and er > es then -q - t else r end}}
    from (select *, abs(q - fq) as eq, abs(r - fr) as er, abs(t - fs) as es
        from (select *, cast(floor(fq + 0.5e0) as bigint) as q,
                     cast(floor(fr + 0.5e0) as bigint) as r,
                     cast(floor(fs + 0.5e0) as bigint) as t
            from (select {fq} as fq, {fr} as fr, -{fq} - {fr} as fs))))"""


# --- test files ----------------------------------------------------------------


def write_geopackages(df: DataFrame, layer: str, srid: int = 27700, parts: int = 4) -> str:
    """One GeoPackage per partition of ``df(destination, x, y)``; returns the folder."""
    folder = scratch_path(df.sparkSession, "gpkg").removeprefix("file:")

    def write(rows):
        import os
        import sqlite3
        import struct
        import uuid

        os.makedirs(folder, exist_ok=True)
        with sqlite3.connect(f"{folder}/{uuid.uuid4().hex}.gpkg") as db:
            db.execute("create table gpkg_contents (table_name text, data_type text)")
            db.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
            db.execute("insert into gpkg_contents values (?, 'features')", (layer,))
            db.execute("insert into gpkg_geometry_columns values (?, 'geometry')", (layer,))
            db.execute(
                f'create table "{layer}" (fid integer primary key, geometry blob, postcode text)'
            )
            db.executemany(
                f'insert into "{layer}" (geometry, postcode) values (?, ?)',
                (
                    (struct.pack("<2sBBi", b"GP", 0, 1, srid)
                     + struct.pack("<BIdd", 1, 1, r.x, r.y), r.destination)
                    for r in rows
                ),
            )

    df.select("destination", "x", "y").repartition(parts).foreachPartition(write)
    return folder


def write_districts(spark: SparkSession, layer: str, srid: int = 27700) -> str:
    """The test districts as one polygon layer of a GeoPackage; returns its folder."""
    import os
    import sqlite3
    import struct

    folder = scratch_path(spark, "gpkg").removeprefix("file:")
    os.makedirs(folder)
    rings: dict[str, list] = {}
    for name, _, points in RINGS:
        rings.setdefault(name, []).append([*points, points[0]])
    with sqlite3.connect(f"{folder}/districts.gpkg") as db:
        db.execute("create table gpkg_contents (table_name text, data_type text)")
        db.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
        db.execute("insert into gpkg_contents values (?, 'features')", (layer,))
        db.execute("insert into gpkg_geometry_columns values (?, 'geometry')", (layer,))
        db.execute(f'create table "{layer}" (fid integer primary key, geometry blob, name text)')
        for name, own in rings.items():
            body = struct.pack("<BII", 1, 3, len(own)) + b"".join(
                struct.pack("<I", len(r)) + struct.pack(f"<{2 * len(r)}d", *(v for xy in r for v in xy)) for r in own)
            db.execute(f'insert into "{layer}" (geometry, name) values (?, ?)',
                       (struct.pack("<2sBBi", b"GP", 0, 1, srid) + body, name))
    return folder
