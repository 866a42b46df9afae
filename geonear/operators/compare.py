"""Comparison of nearest-neighbour results ``(origin, destination, distance)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff_inner(left: DataFrame, right: DataFrame) -> DataFrame:
    """Origins present in both results with different destinations.

    An origin missing on one side does not show up; see :func:`check`.
    """
    a = left.select("origin", F.col("destination").alias("left_destination"),
                    F.col("distance").alias("left_distance"))
    b = right.select("origin", F.col("destination").alias("right_destination"),
                     F.col("distance").alias("right_distance"))
    return a.join(b, "origin").where("left_destination <> right_destination")


def check(result: DataFrame, reference: DataFrame) -> DataFrame:
    """Mismatching origins: another destination, or missing on either side.

    Distances are shown but not compared. NULL is an origin like any other.
    """
    a = reference.select(F.col("origin").alias("origin_x"), F.col("destination").alias("destination_x"),
                         F.col("distance").alias("distance_x"))
    b = result.select(F.col("origin").alias("origin_y"), F.col("destination").alias("destination_y"),
                      F.col("distance").alias("distance_y"))
    same = F.coalesce(F.col("destination_x") == F.col("destination_y"), F.lit(False))
    met = a.join(b, F.col("origin_x").eqNullSafe(F.col("origin_y")), "full_outer").where(~same)
    shown = ("destination_x", "distance_x", "destination_y", "distance_y")
    return met.select(F.coalesce("origin_x", "origin_y").alias("origin"), *shown)


def compare_methods(results: dict[str, DataFrame], reference: DataFrame) -> DataFrame:
    """Per method: rows, mismatches against ``reference`` and whether it agrees.

    The rule is that of :func:`check`, for all methods in one grouping by
    origin instead of one outer join each: a method may have any number of rows
    for an origin, each of which counts; an origin that only the reference has
    is one mismatch; a NULL destination agrees with nothing.  ``reference`` has
    one row per origin at most; of more, the largest destination counts.

    Rows are dealt out once, by their origin. Answers are then counted per origin and
    destination, with a count for each method in place of a row, and no rows are sorted.
    """
    named = list(enumerate(results))
    expected = reference.groupBy("origin").agg(F.max("destination").alias("destination"))
    tagged = [expected.select("origin", "destination", F.lit(-1).alias("method"))]
    tagged += [results[m].select("origin", "destination", F.lit(i).alias("method")) for i, m in named]
    dealt = reduce(DataFrame.unionByName, tagged).repartition("origin")
    answers = dealt.groupBy("origin", "destination").agg(
        F.count_if(F.col("method") == -1).alias("expected"),
        *[F.count_if(F.col("method") == i).alias(f"n{i}") for i, _ in named])
    same = (F.col("expected") > 0) & F.col("destination").isNotNull()
    origins = answers.groupBy("origin").agg(
        F.max("expected").alias("known"),
        *[F.sum(f"n{i}").alias(f"n{i}") for i, _ in named],
        *[F.sum(F.when(same, 0).otherwise(F.col(f"n{i}"))).alias(f"bad{i}") for i, _ in named])
    known = F.col("known") > 0
    # An origin that the reference has and the method hasn't is a mismatch too.
    totals = origins.agg(
        F.max("known").alias("known"),
        *[F.sum(f"n{i}").alias(f"n{i}") for i, _ in named],
        *[(F.coalesce(F.sum(f"bad{i}"), F.lit(0)) + F.count_if(known & (F.col(f"n{i}") == 0))).alias(f"bad{i}")
          for i, _ in named])
    # One row per method: a method without any row must be reported too.
    rows = [F.struct(F.lit(m).alias("method"), F.coalesce(f"n{i}", F.lit(0)).cast("long").alias("n_rows"),
                     F.col(f"bad{i}").cast("long").alias("n_mismatch")) for i, m in named]
    found = totals.select(F.inline(F.array(*rows).cast("array<struct<method:string,n_rows:bigint,n_mismatch:bigint>>")))
    return found.withColumn("agrees", F.col("n_mismatch") == 0)
