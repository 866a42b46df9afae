"""Spatial names for plain SQL text, inlined by Catalyst."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

from geonear.functions.codec import wkb_reader, wkb_writer

# SQL functions are expanded into the query's own expressions: no call is left
# in the plan, and predicates over them are pushed down like any other.
_POINT = "STRUCT<x: DOUBLE, y: DOUBLE>"
_WKT = "^ *POINT *[(] *([-+0-9.eE]+) +([-+0-9.eE]+) *[)] *$"
_SRID_POINT = "STRUCT<x: DOUBLE, y: DOUBLE, srid: INT>"
_CELL = "STRUCT<q: BIGINT, r: BIGINT>"


def _hex_cell() -> str:
    """Cube rounding as in :func:`geonear.functions.hexgrid.hex_cell`, in the same order of operations."""
    root3 = f"{math.sqrt(3.0)!r}D"
    fq, fr = f"(({root3} / 3.0D * px - py / 3.0D) / edge)", "((py * (2.0D / 3.0D)) / edge)"
    fs = f"(-{fq} - {fr})"
    q, r, t = (f"floor({v} + 0.5D)" for v in (fq, fr, fs))
    eq, er, es = (f"abs({a} - {b})" for a, b in ((q, fq), (r, fr), (t, fs)))
    fix_q = f"({eq} > {er} AND {eq} > {es})"
    return (f"named_struct('q', CASE WHEN {fix_q} THEN -{r} - {t} ELSE {q} END, "
            f"'r', CASE WHEN NOT {fix_q} AND {er} > {es} THEN -{q} - {t} ELSE {r} END)")


_DEFINITIONS = (
    f"st_point(px DOUBLE, py DOUBLE) RETURNS {_POINT} RETURN named_struct('x', px, 'y', py)",
    f"st_x(g {_POINT}) RETURNS DOUBLE RETURN g.x",
    f"st_y(g {_POINT}) RETURNS DOUBLE RETURN g.y",
    f"st_distance(g {_POINT}, h {_POINT}) RETURNS DOUBLE "
    "RETURN sqrt((g.x - h.x) * (g.x - h.x) + (g.y - h.y) * (g.y - h.y))",
    f"st_dwithin(g {_POINT}, h {_POINT}, r DOUBLE) RETURNS BOOLEAN "
    "RETURN sqrt((g.x - h.x) * (g.x - h.x) + (g.y - h.y) * (g.y - h.y)) <= r",
    f"st_geomfromtext(t STRING) RETURNS {_POINT} RETURN CASE WHEN t RLIKE '{_WKT}' THEN named_struct("
    f"'x', try_cast(regexp_extract(t, '{_WKT}', 1) AS DOUBLE), "
    f"'y', try_cast(regexp_extract(t, '{_WKT}', 2) AS DOUBLE)) END",
    f"st_astext(g {_POINT}) RETURNS STRING RETURN concat('POINT(', g.x, ' ', g.y, ')')",
    f"st_set_srid(g {_POINT}, s INT) RETURNS {_SRID_POINT} "
    "RETURN CASE WHEN g IS NOT NULL THEN named_struct('x', g.x, 'y', g.y, 'srid', s) END",
    f"st_srid_of(g {_SRID_POINT}) RETURNS INT RETURN g.srid",
    f"st_plain(g {_SRID_POINT}) RETURNS {_POINT} "
    "RETURN CASE WHEN g IS NOT NULL THEN named_struct('x', g.x, 'y', g.y) END",
    f"hex_cell(px DOUBLE, py DOUBLE, edge DOUBLE) RETURNS {_CELL} RETURN {_hex_cell()}",
    f"hex_steps(a {_CELL}, b {_CELL}) RETURNS BIGINT "
    "RETURN greatest(abs(a.q - b.q), abs(a.r - b.r), abs(a.q - b.q + a.r - b.r))",
    f"hex_disk(cell {_CELL}, k INT) RETURNS TABLE (q BIGINT, r BIGINT) "
    "RETURN SELECT cell.q + s.i, cell.r + s.j FROM (SELECT explode(flatten(transform(sequence(-k, k), i -> transform("
    "sequence(greatest(-k, -k - i), least(k, k - i)), j -> named_struct('i', i, 'j', j))))) AS s)",
)


def register_sql_functions(spark: SparkSession) -> None:
    """Register the functions of this module for the session.

    ``st_point, st_x, st_y, st_distance, st_dwithin, st_astext,
    st_geomfromtext``; points with an SRID by ``st_set_srid, st_srid_of`` and back by
    ``st_plain``; ``st_aswkb`` of a point, ``st_pointfromwkb`` (whose points have
    the SRID of EWKB, or NULL); ``hex_cell, hex_steps`` and the table function
    ``hex_disk``, to be joined with ``LATERAL``. What is no point gives NULL.
    """
    for definition in _DEFINITIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {definition}")
    write, read = wkb_writer(), wkb_reader()
    spark.udf.register("st_wkb_of_xy", write)
    spark.udf.register("st_pointfromwkb", read)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION st_aswkb(g {_POINT}) RETURNS BINARY RETURN st_wkb_of_xy(g.x, g.y)")
