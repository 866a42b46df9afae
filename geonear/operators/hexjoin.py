"""Nearest neighbour limited to hexagonal cells around the origin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geonear.functions.geometry import distance, located
from geonear.functions.hexgrid import RES9_EDGE, disk_reach, hex_cell, hex_steps
from geonear.operators.grouping import first_per_key
from geonear.operators.knn import neighbour_lists
from geonear.operators.leaves import Leaves
from geonear.operators.pairs import near_pairs
from geonear.operators.tiles import Tiles
from geonear.session import materialize


def nearest_in_hex_disk(origins: DataFrame, destinations: DataFrame, max_distance: float,
                        edge: float = RES9_EDGE, k: int = 5, round_to: int | None = 2,
                        exact: bool = False, tiles: Tiles | None = None,
                        leaves: Leaves | None = None) -> DataFrame:
    """Nearest destination whose hexagon is within ``k`` steps of the origin's.

    This is an approximation of the nearest destination: one outside the disk
    is not seen, and an origin with an empty disk gets no row.
    ``exact=True`` drops the disk and returns the true nearest.

    If the true nearest lies in the disk it is the answer, and if it lies
    farther than the disk reaches there is none. Pairs are looked at for the
    origins in between only, by cells as wide as the reach: one row per origin.
    """
    lists = neighbour_lists(origins, destinations, 1, max_distance, tiles=tiles, leaves=leaves)
    best = lists.select("origin", "x", "y", F.inline_outer("nearest"))
    if exact:
        found = best
    else:
        steps = hex_steps(
            hex_cell(F.col("x"), F.col("y"), edge), hex_cell(F.col("bx"), F.col("by"), edge)
        )
        best = materialize(best.withColumn("steps", steps), "hex-nearest")
        seen = best.where(F.col("steps") <= k).select("origin", "destination", "distance")
        # Beyond the reach of a disk there is nothing in it either.
        reach = disk_reach(edge, k)
        rest = best.where((F.col("steps") > k) & (F.col("distance") <= reach)).select(
            "origin", F.col("x").alias("ax"), F.col("y").alias("ay"))
        # One key per coordinate is enough for a minimum by (distance, key).
        spots = destinations.groupBy(F.col("x").alias("bx"), F.col("y").alias("by")).agg(
            F.min("destination").alias("destination")
        ).where(located("bx") & located("by"))
        in_disk = hex_steps(
            hex_cell(F.col("ax"), F.col("ay"), edge), hex_cell(F.col("bx"), F.col("by"), edge)) <= k
        met = near_pairs(rest, spots, reach).where(in_disk).select(
            "origin", "destination",
            distance(*[F.col(c) for c in ("ax", "ay", "bx", "by")]).alias("distance"),
        )
        far = first_per_key(
            met.where(F.col("distance") <= float(max_distance)), ["origin"],
            ["distance", "destination"],
        )
        found = seen.unionByName(far)
    found = found.select("origin", "destination", "distance")
    return found if round_to is None else found.withColumn("distance", F.round("distance", round_to))
