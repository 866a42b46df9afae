"""Planar point expressions: constructors, distances and predicates.

Every function returns a Column built from Spark's own functions, so it stays
inside whole-stage code generation and can be pushed around by Catalyst.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SRID_KEY = "srid"


def point(x: Column, y: Column) -> Column:
    """A point value: ``struct<x: double, y: double>``, NULL if a part is NULL."""
    made = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.when(x.isNotNull() & y.isNotNull(), made)


def with_srid(df: DataFrame, col: str, srid: int) -> DataFrame:
    """Record the coordinate system of ``col`` in its column metadata."""
    return df.withMetadata(col, {**df.schema[col].metadata, SRID_KEY: srid})


def srid_of(df: DataFrame, col: str) -> int | None:
    return df.schema[col].metadata.get(SRID_KEY)


def distance_sq(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Euclidean distance. The one formula used everywhere, so ties stay ties."""
    return F.sqrt(distance_sq(ax, ay, bx, by))


def dwithin(ax: Column, ay: Column, bx: Column, by: Column, r: float) -> Column:
    """Inside the closed circle of radius ``r``."""
    return distance(ax, ay, bx, by) <= F.lit(float(r))


def bbox_within(ax: Column, ay: Column, bx: Column, by: Column, r: float) -> Column:
    """Inside the closed square of half-width ``r`` (wider than the circle)."""
    r = F.lit(float(r))
    return (F.abs(ax - bx) <= r) & (F.abs(ay - by) <= r)


def located(name: str) -> Column:
    """Whether a coordinate is a number: rows with NULL, NaN or infinite ones lie nowhere."""
    return F.coalesce(F.abs(name) < F.lit(math.inf), F.lit(False))


def grid_index(v: Column, size: float) -> Column:
    """Index of the square grid row or column of width ``size`` holding ``v``."""
    return F.floor(v / F.lit(float(size)))
