"""Nearest-neighbour joins.

Origins are ``(origin, x, y)``, destinations ``(destination, x, y)``; results
are ``(origin, destination, distance)``.  All of them rank on the unrounded
distance, then on the destination key, and round last.

Neighbours come from a search over leaves of destinations, or, with ``tiles`` from
:func:`build_tiles`, which calls on the same tables can share, by those. Calls on the same
destinations can share ``leaves`` from :func:`build_leaves` for their ``k``. Forms that
rank pairs can share ``pairs`` from :func:`candidate_pairs` instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geonear.functions.geometry import distance
from geonear.operators.grouping import first_per_key, number_keys
from geonear.operators.leaves import Leaves, build_leaves, search_leaves
from geonear.operators.tiles import TILE_KEY, Tiles

HOW = ("inner", "left", "error")


def _round(df: DataFrame, digits: int | None) -> DataFrame:
    if digits is None:
        return df
    return df.withColumn("distance", F.round("distance", digits))


def _leaves(destinations: DataFrame, k: int, leaves: Leaves | None) -> Leaves:
    """The given leaves, which must be for ``k`` neighbours, or new ones."""
    if leaves is None:
        return build_leaves(destinations, k)
    if leaves.k != k:
        raise ValueError(f"leaves for k={leaves.k} used for k={k}")
    return leaves


def nearest_lists(origins: DataFrame, tiles: Tiles, how: str = "inner") -> DataFrame:
    """``(origin, x, y, nearest)`` by tiles: one equi-join, in which each origin row meets one tile row."""
    seen = origins.select("origin", "x", "y")
    found = tiles.nearest(tiles.locate(seen), ["origin", "x", "y"])
    if how != "inner":
        # By coordinates, on which alone a list depends: ids may be NULL or repeat.
        spots = seen.select("x", "y").distinct()
        lists = tiles.nearest(tiles.locate(spots), ["x", "y"])
        found = seen.join(lists, ["x", "y"], "left").select("origin", "x", "y", "nearest")
    return found


def neighbour_lists(origins: DataFrame, destinations: DataFrame, k: int | None = 1, max_distance: float | None = None,
                    how: str = "inner", tiles: Tiles | None = None, first: int | None = None,
                    leaves: Leaves | None = None) -> DataFrame:
    """``(origin, x, y, nearest)``: the ranked neighbours of each origin as an array.

    By leaves, or by ``tiles`` where given. Without a neighbour an origin has no
    row (``how="inner"``), a NULL list (``"left"``), or makes the job fail
    (``"error"``). The ``first`` of the ``k`` neighbours are kept, if given.
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {', '.join(HOW)}")
    if tiles is not None:
        found = nearest_lists(origins, tiles.require(destinations, origins, k, max_distance, False), how)
        if first:
            found = found.withColumn("nearest", F.slice("nearest", 1, first))
    else:
        found = search_leaves(origins, _leaves(destinations, k or 1, leaves), max_distance, first=first)
    some = F.coalesce(F.size("nearest") > 0, F.lit(False))
    if how == "inner":
        return found if tiles is not None else found.where(some)
    missing = F.raise_error(F.concat(F.lit("no destination for origin "), F.coalesce(F.col("origin").cast("string"), F.lit("NULL"))))
    otherwise = missing if how == "error" else F.lit(None)
    return found.withColumn("nearest", F.when(some, F.col("nearest")).otherwise(otherwise))


def _neighbours(lists: DataFrame, round_to: int | None = None) -> DataFrame:
    # Lists are never empty, so "outer" adds no row; it only keeps Catalyst from
    # inferring a filter that would build the list a second time.
    rows = lists.select("origin", F.inline_outer("nearest"))
    return _round(rows.select("origin", "destination", "distance"), round_to)


def knn_join(
    origins: DataFrame,
    destinations: DataFrame,
    k: int | None = None,
    max_distance: float | None = None,
    how: str = "inner",
    round_to: int | None = None,
    tiles: Tiles | None = None,
    leaves: Leaves | None = None,
) -> DataFrame:
    """The ``k`` (default 1, or that of the tiles) nearest destinations of every origin.

    One row per neighbour.  ``how="left"`` keeps origins without a match, with
    NULLs; ``how="error"`` fails on the first such origin, in the same pass.
    """
    return _neighbours(neighbour_lists(origins, destinations, k, max_distance, how, tiles, leaves=leaves), round_to)


def nearest(
    origins: DataFrame,
    destinations: DataFrame,
    max_distance: float | None = None,
    how: str = "inner",
    round_to: int | None = None,
    tiles: Tiles | None = None,
    leaves: Leaves | None = None,
) -> DataFrame:
    """The nearest destination of every origin; ties go to the smallest key."""
    return knn_join(origins, destinations, 1, max_distance, how, round_to, tiles, leaves)


def knn_join_top1(origins: DataFrame, destinations: DataFrame, k: int,
                  max_distance: float | None = None, tiles: Tiles | None = None) -> DataFrame:
    """Take ``k`` neighbours, then the first of them by (distance, key)."""
    return _neighbours(neighbour_lists(origins, destinations, k, max_distance, tiles=tiles, first=1))


def knn_rounded_first(origins: DataFrame, destinations: DataFrame, k: int = 5,
                      digits: int = 2, tiles: Tiles | None = None) -> DataFrame:
    """Round the distances of the ``k`` neighbours *before* choosing the first.

    Rounding makes extra ties, which the key then decides.
    """
    rounded = F.transform(
        "nearest",
        lambda m: F.struct(
            F.round(m["distance"], digits).alias("distance"), m["destination"].alias("destination")
        ),
    )
    lists = neighbour_lists(origins, destinations, k, None, tiles=tiles)
    best = lists.select("origin", F.array_min(rounded).alias("best"))
    return best.select("origin", "best.destination", "best.distance")


def nearest_in_square(origins: DataFrame, destinations: DataFrame, max_distance: float,
                      tiles: Tiles | None = None, leaves: Leaves | None = None) -> DataFrame:
    """Nearest destination within the *square* of half-width ``max_distance``.

    Distances up to ``max_distance * sqrt(2)`` can come out, at the corners.
    """
    if tiles is None:
        found = search_leaves(origins, _leaves(destinations, 1, leaves), max_distance, square=True)
        return _neighbours(found.where(F.size("nearest") > 0))
    return _neighbours(nearest_lists(origins, tiles.require(destinations, origins, 1, max_distance, True)))


def nearest_all_ties(origins: DataFrame, destinations: DataFrame,
                     max_distance: float | None = None, tiles: Tiles | None = None) -> DataFrame:
    """Every destination at the smallest distance, several rows per origin if tied.

    Places are searched without their keys, which meet the origins at the end.
    They do so by a sorted join: rows of one place then leave together, and a
    file holds their (maybe long) key once and not for every origin.
    """
    if tiles is None:
        places = destinations.select(F.lit(0).alias("destination"), "x", "y")
        found = search_leaves(origins, build_leaves(places), max_distance, ties=True)
    else:
        tiles = tiles.require(destinations, origins, 1, max_distance, False)
        found = tiles.nearest(tiles.locate(origins.select("origin", "x", "y")), ["origin"], ties=True)
    spots = found.select("origin", F.inline("nearest")).select("origin", "distance", "bx", "by")
    keys = destinations.select("destination", F.col("x").alias("bx"), F.col("y").alias("by"))
    return spots.join(keys.hint("merge"), ["bx", "by"]).select("origin", "destination", "distance")


def nearest_first_of_ties(origins: DataFrame, destinations: DataFrame,
                          max_distance: float | None = None,
                          tiles: Tiles | None = None) -> DataFrame:
    """All ties first, then the smallest key of each origin.

    Keys are numbered, so that ties are gathered and compared without them; the
    key of the first joins its origins at the end, as in :func:`nearest_all_ties`.
    """
    if tiles is not None:
        return first_per_key(nearest_all_ties(origins, destinations, max_distance, tiles), ["origin"], ["destination"])
    numbered, names = number_keys(destinations.select("destination", "x", "y"))
    found = search_leaves(origins, build_leaves(numbered), max_distance, ties=True)
    # One number per place stands for all of it: the smallest.
    tied = found.select("origin", F.inline("nearest")).select("origin", "destination", "distance")
    best = first_per_key(tied, ["origin"], ["destination"]).withColumnRenamed("destination", "number")
    return best.join(names.hint("merge"), "number").select("origin", "destination", "distance")


def candidate_pairs(origins: DataFrame, destinations: DataFrame, max_distance: float | None = None,
                    tiles: Tiles | None = None, leaves: Leaves | None = None) -> DataFrame:
    """Pairs ``(origin, destination, distance)`` within the cap that can be nearest.

    The nearest of an origin's own leaf, and of the other leaves that begin no
    farther away; with ``tiles``, all of its tile's list. Either way their number
    is bounded, however many destinations lie inside the cap.
    """
    if tiles is None:
        found = search_leaves(origins, _leaves(destinations, 1, leaves), max_distance, merged=False)
        return found.select("origin", F.inline("nearest")).select("origin", "destination", "distance")
    tiles = tiles.require(destinations, origins, 1, max_distance, False)
    met = tiles.locate(origins.select("origin", "x", "y")).join(tiles.candidates(), TILE_KEY)
    ax, ay, bx, by = (F.col(c) for c in ("x", "y", "bx", "by"))
    return met.where(tiles.within_cap(ax, ay, bx, by)).select(
        "origin", "destination", distance(ax, ay, bx, by).alias("distance")
    )


def candidate_places(origins: DataFrame, destinations: DataFrame, max_distance: float | None = None,
                     leaves: Leaves | None = None) -> DataFrame:
    """``(x, y, destination, bx, by)``: what :func:`candidate_pairs` has, once for each distinct place of origins."""
    places = origins.select("x", "y").distinct().withColumn("origin", F.lit(0))
    found = search_leaves(places, _leaves(destinations, 1, leaves), max_distance, merged=False)
    return found.select("x", "y", F.inline("nearest")).select("x", "y", "destination", "bx", "by")


def nearest_by_window(origins: DataFrame, destinations: DataFrame, max_distance: float, round_to: int | None = 2,
                      tiles: Tiles | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Nearest through ``row_number() = 1`` over the candidate pairs."""
    pairs = candidate_pairs(origins, destinations, max_distance, tiles) if pairs is None else pairs
    order = Window.partitionBy("origin").orderBy("distance", "destination")
    best = pairs.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
    return _round(best.select("origin", "destination", "distance"), round_to)


def nearest_distinct_on(origins: DataFrame, destinations: DataFrame, max_distance: float, round_to: int | None = 2,
                        tiles: Tiles | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Nearest as "one row per origin in this order", by an ordered minimum."""
    pairs = candidate_pairs(origins, destinations, max_distance, tiles) if pairs is None else pairs
    best = first_per_key(pairs, ["origin"], ["distance", "destination"])
    return _round(best.select("origin", "destination", "distance"), round_to)


def nearest_sort_dedupe(origins: DataFrame, destinations: DataFrame, max_distance: float,
                        tiles: Tiles | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """First row per origin of the sorted pairs, unrounded.

    Spark does not promise that ``dropDuplicates`` keeps the first sorted row,
    so the order is part of the aggregate and no global sort is run.
    """
    return nearest_distinct_on(origins, destinations, max_distance, None, tiles, pairs)


def nearest_all_vs_all(origins: DataFrame, destinations: DataFrame,
                       tiles: Tiles | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Arg-min over all destinations, no cap: the answer of an all-pairs scan.

    Only pairs that can win are looked at.
    """
    pairs = candidate_pairs(origins, destinations, None, tiles) if pairs is None else pairs
    rank = F.struct("distance", "destination")
    return pairs.groupBy("origin").agg(
        F.min_by("destination", rank).alias("destination"), F.min("distance").alias("distance")
    )


def nearest_lateral(origins: DataFrame, destinations: DataFrame, max_distance: float,
                    round_to: int | None = 2, tiles: Tiles | None = None,
                    leaves: Leaves | None = None) -> DataFrame:
    """Nearest through a correlated ``LATERAL (… ORDER BY … LIMIT 1)`` subquery.

    The outer columns enter the subquery as a one-row relation that is joined
    to the candidates of the same place (with ``tiles``, of the same tile).
    Catalyst decorrelates that into an equi-join with the distinct outer
    coordinates and a per-group limit; written as plain ``WHERE c.x = a.x`` it
    would pull the equalities up and loop over all pairs.
    """
    seen = origins.select("origin", "x", "y")
    if tiles is None:
        candidates = candidate_places(origins, destinations, max_distance, leaves).select(
            F.struct("x", "y").alias("at"), "destination", "bx", "by")
        outer = seen.selectExpr("origin", "x as ax", "y as ay", "struct(x, y) as at")
    else:
        tiles = tiles.require(destinations, origins, 1, max_distance, False)
        candidates = tiles.candidates().selectExpr("struct(level, tx, ty) as at", "destination", "bx", "by")
        outer = tiles.locate(seen).selectExpr("origin", "x as ax", "y as ay", "struct(level, tx, ty) as at")
    best = origins.sparkSession.sql(
        """
        SELECT a.origin, b.destination, b.distance
        FROM {outer} a, LATERAL (
            SELECT c.destination,
                   sqrt((o.x - c.bx) * (o.x - c.bx) + (o.y - c.by) * (o.y - c.by)) AS distance
            FROM (SELECT a.ax AS x, a.ay AS y, a.at) o
            JOIN {candidates} c ON c.at = o.at
            WHERE sqrt((o.x - c.bx) * (o.x - c.bx) + (o.y - c.by) * (o.y - c.by)) <= {cap}
            ORDER BY distance, c.destination
            LIMIT 1
        ) b
        """,
        # New column names: shared ones would clash where this result meets
        # another one of the same origins.
        outer=outer, candidates=candidates, cap=float(max_distance),
    )
    return _round(best, round_to)
