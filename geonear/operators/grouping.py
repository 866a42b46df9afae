"""Grouping operators: co-located points, first and last row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geonear.session import materialize


def group_colocated(points: DataFrame, key: str = "destination", sep: str = ",") -> DataFrame:
    """One row per coordinate; ``key`` becomes its sorted, ``sep``-joined keys."""
    joined = F.array_join(F.sort_array(F.collect_list(F.col(key).cast("string"))), sep)
    return points.groupBy("x", "y").agg(joined.alias(key))


def _extreme_per_key(df: DataFrame, key: list[str], order: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in key and c not in order]
    best = df.groupBy(*key).agg(pick(F.struct(*order, *rest)).alias("__best"))
    return best.select(*key, *[F.col("__best")[c].alias(c) for c in df.columns if c not in key])


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row per ``key`` in the stated order (combined before the shuffle).

    Rows that tie on ``order`` are told apart by their other columns.
    """
    return _extreme_per_key(df, key, order, F.min)


def last_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row per ``key`` in the stated order: "last write wins"."""
    return _extreme_per_key(df, key, order, F.max)


def number_keys(points: DataFrame, key: str = "destination") -> tuple[DataFrame, DataFrame]:
    """``points`` with numbers in place of ``key``, and ``(number, key)``.

    Numbers have the order of the keys, and equal keys the same number, so
    whatever ranks or compares keys may do it on numbers. Long keys then needn't
    travel with each row that refers to them. NULL is a key like any other.
    """
    ordered = points.select(key).distinct().sort(key)
    names = materialize(ordered.select(F.monotonically_increasing_id().alias("number"), key), "key-numbers")
    met = points.join(names.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key")))
    return met.select(*[F.col("number").alias(c) if c == key else c for c in points.columns]), names
