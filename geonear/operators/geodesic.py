"""Nearest neighbour by distance on the sphere, for points on the British grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geonear.functions.geodesy import geodesic_distance, reproject_points
from geonear.operators.grouping import first_per_key
from geonear.operators.knn import _leaves
from geonear.operators.leaves import Leaves, search_leaves

#: Distances on the grid and on the sphere differ by less than this share in
#: the grid's area: scale of the projection below 0.1 %, radii of curvature
#: against the mean radius below 0.5 %.
MARGIN = 0.01


def nearest_geodesic(origins: DataFrame, destinations: DataFrame, max_distance: float,
                     round_to: int | None = 2, leaves: Leaves | None = None) -> DataFrame:
    """Nearest destination at most ``max_distance`` away on the sphere.

    Ranks on the great circle, then on the key; the distance that comes out is
    the one on the spheroid. Origins without a neighbour have no row; rows that
    repeat an ``origin`` count as one, at the nearest of their places.

    The nearest on the sphere is among those that are at most twice ``MARGIN``
    farther on the grid than the nearest there, and these places alone are looked
    for, however many; a place has its smallest key.
    """
    cap = float(max_distance) * (1 + MARGIN)
    slack = (1 + MARGIN) / (1 - MARGIN)
    found = search_leaves(origins, _leaves(destinations, 1, leaves), cap, ties=True, slack=slack)
    pairs = found.select("origin", F.col("x").alias("ax"), F.col("y").alias("ay"), F.inline("nearest"))
    for x, y, lat, lon in (("ax", "ay", "a_lat", "a_lon"), ("bx", "by", "b_lat", "b_lon")):
        pairs = reproject_points(pairs, lat, lon, x, y)
    ends = ["a_lat", "a_lon", "b_lat", "b_lon"]
    # The spheroid and the cap come after the choice: before it they'd make one method of
    # more code than the JVM compiles, and a filter would compute the sphere once more.
    near = pairs.select("origin", "destination", *ends, geodesic_distance(*map(F.col, ends)).alias("sphere"))
    best = first_per_key(near, ["origin"], ["sphere", "destination"]).where(F.col("sphere") <= float(max_distance))
    best = best.select("origin", "destination", geodesic_distance(*map(F.col, ends), spheroid=True).alias("distance"))
    return best if round_to is None else best.withColumn("distance", F.round("distance", round_to))
