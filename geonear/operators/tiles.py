"""Destination tiles: the distributed pruning structure behind every KNN join.

The plane is cut into square tiles.  A tile carries a short list of candidate
destinations that is certain to hold the k nearest destinations of *every*
point of the tile.  A KNN join is then one equi-join of origins with tiles, one
row per origin, plus a look at that list: no pair is ever shuffled, and no
grouping by origin is needed afterwards.

Tiles of all levels are disjoint intervals of the Morton curve in their coarse
cell.  An origin finds the level of its tile in the ordered intervals, which
every executor has while they are few; of more tiles it has the first of every
run, and the origin meets its run by an equi-join.  Either way one row leaves
per origin, whatever the number of levels.

Tiles are made by refining cells top-down, all cells of a level at once:

* start with coarse tiles; the candidates of a tile are coarse *cells* with
  the number of destinations in each;
* a bound ``U`` on the k-th distance inside the tile follows from the farthest
  corners of the nearest cells; cells whose nearest corner is beyond ``U`` (or
  beyond the distance cap) are dropped;
* each tile is cut in four, twice, and its cells with it; the shorter lists of
  the small tiles follow from the list of the large one;
* a tile with few enough destinations left is finished; the crowded ones go
  through the next round.

So crowded areas get small tiles and empty ones large tiles: a city that holds
a third of all destinations does not make its neighbours scan it, and a point
that holds a third of them is reduced to its k smallest keys before any
shuffle.  The work is done on cell counts; the destinations themselves are
joined once, at the end.

A tile far from a tight cluster stays crowded until it is as small as the
cluster.  So only tiles with an origin in them are stored at all: in every
round there is at most one tile per distinct origin coordinate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geonear.functions.geometry import bbox_within, distance, located
from geonear.functions.ranking import nearest_slots, useful_cells
from geonear.functions.search import interval_index, last_before, run_starts, tile_interval, tile_levels
from geonear.session import materialize, materialize_measured

SPLIT = 4  # one round turns a tile into SPLIT x SPLIT tiles, by halving twice
MAX_LEVEL = 15  # 4**15 steps below the coarsest tile: 5 micrometres for 5 km
TILE_KEY = ["level", "tx", "ty"]
COARSE_CELLS = 8  # coarsest grid of an uncapped search, per axis
#: Intervals that every executor gets (24 bytes each); of more tiles, the first of each run.
MAX_INTERVALS = 1 << 20
_BITS = SPLIT.bit_length() - 1


def _cell(v: Column, size: float, level: float) -> Column:
    # Scaling by a power of two is exact, so the levels nest exactly.
    return F.floor(v / F.lit(float(size)) * F.lit(float(SPLIT**level)))


@dataclass
class Tiles:
    """Finished tiles for one pair of tables, one ``k`` and one cap.

    ``table`` has ``level, tx, ty, candidates``; it is stored on shared storage
    and can serve any number of queries on those tables.
    """

    table: DataFrame
    size: float
    levels: list[int]
    k: int
    max_distance: float | None
    square: bool
    destinations: DataFrame | None = None
    origins: DataFrame | None = None
    found: tuple | None = None  # the intervals, once looked at

    def require(self, destinations: DataFrame | None, origins: DataFrame | None, k: int | None,
                max_distance: float | None, square: bool) -> Tiles:
        """These tiles, if they are the ones such a query needs; else an error.

        ``k`` and ``max_distance`` may be ``None`` for "those of the tiles".
        Tiles without an origin aren't kept, so other origins would lose rows.
        """
        asked = {"k": k, "max_distance": max_distance, "square": square}
        for name, value in asked.items():
            if value is not None and value != getattr(self, name):
                raise ValueError(f"the tiles were built for {name}={getattr(self, name)}, not {value}")
        for name, df in (("destinations", destinations), ("origins", origins)):
            own = getattr(self, name)
            if df is not None and own is not None and not df.sameSemantics(own):
                raise ValueError(f"the tiles were built for other {name}")
        return self

    def scale(self, level: int) -> float:
        """Tiles of ``level`` per coarsest cell and axis."""
        return float(SPLIT**level)

    def locate(self, origins: DataFrame) -> DataFrame:
        """Origins with the key ``level, tx, ty`` of the tile they lie in: one row each, or none."""
        origins = origins.where(located("x") & located("y"))
        if len(self.levels) == 1:
            at = (f"{self.levels[0]} as level", *(
                f"floor({v} / {self.size!r}D * {self.scale(self.levels[0])!r}D) as t{v}" for v in "xy"))
            return origins.selectExpr("*", *at)
        found, run = self._intervals()
        if run is None:
            level = _level_udf(found, self.size)(F.col("x").cast("double"), F.col("y").cast("double"))
        else:
            # A point lies in the last tile of its run that begins before it.
            finest = self.levels[-1]
            place = _place_udf(found, self.size, finest)(F.col("x").cast("double"), F.col("y").cast("double"))
            origins = origins.withColumn("__p", place).withColumn("run", F.col("__p.run")).join(run, "run")
            own = F.struct("__p.cx", "__p.cy", "__p.lo")
            last = F.try_element_at(F.filter("tiles", lambda t: F.struct(t["cx"], t["cy"], t["lo"]) <= own), F.lit(-1))
            width = F.expr(f"shiftleft(1L, {2 * _BITS} * ({finest} - last.level))")
            origins = origins.withColumn("last", last).where(
                (F.col("last.cx") == F.col("__p.cx")) & (F.col("last.cy") == F.col("__p.cy"))
                & (F.col("__p.lo") - F.col("last.lo") < width))
            level = F.col("last.level")
        kept = [c for c in origins.columns if c not in ("__p", "run", "tiles", "last")]
        scale = F.pow(F.lit(float(SPLIT)), F.col("level"))
        return origins.withColumn("level", level).where("level >= 0").select(*kept, "level", *[
            F.floor(F.col(v) / F.lit(self.size) * scale).alias(f"t{v}") for v in ("x", "y")])

    def _intervals(self) -> tuple[dict, DataFrame | None]:
        """The tiles along the curve; with more than ``MAX_INTERVALS``, the first of each run, and the runs."""
        if self.found is None:
            finest, n = self.levels[-1], self.table.count()
            keys = self.table.select(F.col("level").cast("long").alias("level"), "tx", "ty")
            if n <= MAX_INTERVALS:
                at = keys.toArrow()
                self.found = interval_index(*(at.column(c).to_numpy() for c in at.schema.names), finest, _BITS), None
            else:
                self.found = _runs(keys, finest, -(-n // MAX_INTERVALS))
        return self.found

    def candidates(self) -> DataFrame:
        """One row per tile and candidate: ``level, tx, ty, destination, bx, by``."""
        return self.table.select("level", "tx", "ty", F.inline("candidates")).select(
            "level", "tx", "ty", "destination",
            F.col("x").alias("bx"), F.col("y").alias("by"),
        )

    def within_cap(self, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
        if self.max_distance is None:
            return F.lit(True)
        if self.square:
            return bbox_within(ax, ay, bx, by, self.max_distance)
        return distance(ax, ay, bx, by) <= F.lit(float(self.max_distance))

    def nearest(self, located: DataFrame, keep: list[str], ties: bool = False,
                first: int | None = None) -> DataFrame:
        """``keep`` plus ``nearest``: the ranked ``array<struct<distance, destination>>``.

        ``located`` comes from :meth:`locate`.  With ``ties`` the list holds the
        coordinates of all destinations at the smallest distance instead.  Only
        the ``first`` of the ``k`` neighbours are looked up, if given.
        """
        pick = nearest_slots(None if ties else self.k, self.max_distance, self.square)
        met = located.join(self.table, TILE_KEY)
        found = met.withColumn(
            "slots", pick(F.col("x"), F.col("y"), F.col("candidates.x"), F.col("candidates.y"))
        ).where("size(slots) > 0")
        value = (
            "named_struct('distance', s.distance, 'bx', candidates[s.slot].x, 'by', candidates[s.slot].y)"
            if ties
            else "named_struct('distance', s.distance, 'destination', candidates[s.slot].destination, "
            "'bx', candidates[s.slot].x, 'by', candidates[s.slot].y)"
        )
        slots = f"slice(slots, 1, {first})" if first else "slots"
        return found.selectExpr(*keep, f"transform({slots}, s -> {value}) as nearest")


def _level_udf(index: dict, size: float):
    def level(x, y):
        import pyarrow as pa

        return pa.array(tile_levels(index, *(v.to_numpy(zero_copy_only=False) for v in (x, y)), size).astype("i4"))

    return F.arrow_udf(level, "int").asNondeterministic()


def _place_udf(starts: dict, size: float, finest: int):
    """UDF ``(x, y) -> struct<run, cx, cy, lo>``: place on the curve, and the run that begins last before it."""
    def place(x, y):
        import numpy as np
        import pyarrow as pa

        scale = float(1 << _BITS * finest)
        fine = (np.floor(v.to_numpy(zero_copy_only=False) / size * scale).astype(np.int64) for v in (x, y))
        at = tile_interval(np.int64(finest), *fine, finest, _BITS)
        run = last_before(starts, at)
        return pa.StructArray.from_arrays([pa.array(v) for v in (run, *at)], names=["run", "cx", "cy", "lo"])

    return F.arrow_udf(place, "struct<run: long, cx: long, cy: long, lo: long>").asNondeterministic()


def _runs(keys: DataFrame, finest: int, length: int) -> tuple[dict, DataFrame]:
    """Runs of ``length`` tiles along the curve: the first place of each, and ``run, tiles``."""
    def place(level, tx, ty):
        import pyarrow as pa

        parts = tile_interval(*(v.to_numpy() for v in (level, tx, ty)), finest, _BITS)
        return pa.StructArray.from_arrays([pa.array(v) for v in parts], names=["cx", "cy", "lo"])

    placed = keys.withColumn("p", F.arrow_udf(place, "struct<cx: long, cy: long, lo: long>")("level", "tx", "ty"))
    ranged = placed.select("p.*", "level").repartitionByRange("cx", "cy", "lo").withColumn("part", F.spark_partition_id())
    nth = F.row_number().over(Window.partitionBy("part").orderBy("cx", "cy", "lo"))
    run = F.shiftleft(F.col("part").cast("long"), 32) + F.floor((nth - 1) / length)
    table = materialize(ranged.withColumn("run", run).groupBy("run").agg(
        F.sort_array(F.collect_list(F.struct("cx", "cy", "lo", "level"))).alias("tiles")), "tile-runs")
    first = table.select("run", F.col("tiles")[0].alias("t")).select("run", "t.cx", "t.cy", "t.lo").toArrow()
    return run_starts(*(first.column(c).to_numpy() for c in first.schema.names)), table


def _reduce_to_k(destinations: DataFrame, k: int) -> DataFrame:
    """One row per coordinate with its ``k`` smallest keys.

    Both forms combine before the shuffle, so a coordinate shared by any number
    of rows sends at most ``k`` of them per task.
    """
    known = destinations.select("destination", "x", "y").where(located("x") & located("y"))
    if k == 1:
        kept = known.groupBy("x", "y").agg(F.array(F.min("destination")).alias("keys"))
    else:
        order = Window.partitionBy("x", "y").orderBy("destination")
        kept = (
            known.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k)
            .groupBy("x", "y")
            .agg(F.sort_array(F.collect_list("destination")).alias("keys"))
        )
    return kept.withColumn("n", F.size("keys").cast("long"))


def _nested_counts(points: DataFrame, size: float, level: int) -> DataFrame:
    """Destinations per cell: ``qx, qy, n`` at ``level``, with ``kids`` twice halved.

    Counted once at the finest of the three grids, then rolled up; no cell has
    more than four kids.
    """
    fine = points.groupBy(
        _cell(F.col("x"), size, level + 1).alias("qx"),
        _cell(F.col("y"), size, level + 1).alias("qy"),
    ).agg(F.sum("n").alias("n"))
    half = F.floor(F.col("qx") / 2).alias("hx"), F.floor(F.col("qy") / 2).alias("hy")
    middle = (
        fine.groupBy(*half)
        .agg(F.sum("n").alias("n"), F.collect_list(F.struct("qx", "qy", "n")).alias("kids"))
        .withColumnsRenamed({"hx": "qx", "hy": "qy"})
    )
    return (
        middle.groupBy(*half)
        .agg(F.sum("n").alias("n"), F.collect_list(F.struct("qx", "qy", "n", "kids")).alias("kids"))
        .withColumnsRenamed({"hx": "qx", "hy": "qy"})
    )


def _prune(tiles: DataFrame, cell: float, k: int, cap: float | None, square: bool) -> DataFrame:
    """Drop the cells that cannot matter to their tile, and tiles left with none."""
    keep = useful_cells(k, math.inf if cap is None else cap / cell, square)
    slots = keep(*[F.col(c) for c in ("tx", "ty", "cells.qx", "cells.qy", "cells.n")])
    return (
        tiles.withColumn("slots", slots)
        .where("size(slots) > 0")
        .selectExpr("tx", "ty", "transform(slots, i -> cells[i]) as cells")
    )


def _halve(tiles: DataFrame) -> DataFrame:
    """Cut each tile in four; its cells give way to their kids."""
    return tiles.selectExpr(
        "tx", "ty", "flatten(transform(cells, c -> c.kids)) as cells", "explode(array(0, 1)) as i"
    ).selectExpr("2 * tx + i as tx", "ty", "cells", "explode(array(0, 1)) as j").selectExpr(
        "tx", "2 * ty + j as ty", "cells"
    )


def build_tiles(
    destinations: DataFrame,
    origins: DataFrame,
    k: int = 1,
    max_distance: float | None = None,
    square: bool = False,
    leaf_size: int | None = None,
) -> Tiles:
    """Tiles for the ``k`` nearest rows of ``destinations(destination, x, y)``.

    With ``max_distance`` only destinations within the circle (``square``: the
    square) of that radius count.  The tiles serve the points of
    ``origins(x, y)`` only; passing them to a query on other tables, or of
    another ``k`` or cap, is an error.  Rows whose coordinates are NULL, NaN or
    infinite have no neighbours.  The tiles are built by several jobs before
    this returns.  ``leaf_size`` is the list length at which cutting
    ends (default 128 + 4k, at least 8k); it never limits a result.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if max_distance is None and square:
        raise ValueError("a square needs a cap")
    if max_distance is not None and max_distance <= 0:
        raise ValueError("max_distance must be positive")
    leaf_size = max(leaf_size or 128 + 4 * k, 8 * k)
    x, y = F.col("x"), F.col("y")
    box = dict(x0=F.min(x), x1=F.max(x), y0=F.min(y), y1=F.max(y))
    points, seen = materialize_measured(
        _reduce_to_k(destinations, k), "points", rows=F.count("*"), **box
    )
    bound = dict(destinations=destinations, origins=origins)
    if not seen["rows"]:
        return Tiles(_no_tiles(destinations), 1.0, [0], k, max_distance, square, **bound)
    # The origins' source is read here once, whatever the number of rounds.
    spots, asked_box = materialize_measured(
        origins.select("x", "y").where(located("x") & located("y")).distinct(), "asked", **box)

    if max_distance is not None:
        size, reach = _capped_grid(seen, float(max_distance))
        # Every tile within the cap of a destination; nobody else has a match.
        start = _nested_counts(points, size, 0)
        for t, q in (("tx", "qx"), ("ty", "qy")):
            start = start.selectExpr("*", f"explode(sequence({q} - {reach}, {q} + {reach})) as {t}")
    else:
        span = {
            side: pick(v for v in (asked_box[side], seen[side]) if v is not None)
            for side, pick in (("x0", min), ("x1", max), ("y0", min), ("y1", max))
        }
        width = max(span["x1"] - span["x0"], span["y1"] - span["y0"])
        # A power of two keeps the cell size exact.
        size = 2.0 ** math.ceil(math.log2(width / COARSE_CELLS)) if width > 0 else 1.0
        first = {side: F.lit(math.floor(v / size)).cast("long") for side, v in span.items()}
        # At most (COARSE_CELLS + 2)² tiles, each seeing as many cells.
        start = (
            _nested_counts(points, size, 0)
            .withColumn("tx", F.explode(F.sequence(first["x0"], first["x1"])))
            .withColumn("ty", F.explode(F.sequence(first["y0"], first["y1"])))
        )
    parallel = points.sparkSession.sparkContext.defaultParallelism
    crowded = start.repartition(parallel, "tx", "ty").groupBy("tx", "ty").agg(
        F.collect_list(F.struct("qx", "qy", "n", "kids")).alias("cells")
    )
    crowded = _prune(crowded, size, k, max_distance, square)

    finished, levels = [], []
    for level in range(1, MAX_LEVEL + 1):
        cell = size / SPLIT**level
        middle = _prune(_halve(crowded), 2 * cell, k, max_distance, square)
        # A tile without origins would never be met: it is neither kept nor cut again.
        occupied = spots.select(
            _cell(x, size, level).alias("tx"), _cell(y, size, level).alias("ty")
        ).distinct()
        small = _prune(_halve(middle).join(occupied, ["tx", "ty"], "left_semi"), cell, k, max_distance, square)
        left = F.expr(f"aggregate(cells, 0L, (acc, c) -> acc + c.n) <= {leaf_size}")
        done = F.lit(True) if level == MAX_LEVEL else left
        state, counts = materialize_measured(
            small.withColumn("done", done), f"tiles-level{level}",
            done=F.count_if("done"), crowded=F.count_if(~F.col("done")),
        )
        if counts["done"]:
            levels.append(level)
            finished.append(state.where("done").select(F.lit(level).alias("level"), "tx", "ty", "cells"))
        if not counts["crowded"]:
            break
        tasks = max(1, min(counts["crowded"] // 16, 4 * parallel), counts["crowded"] // 50_000)
        crowded = _with_kids(state.where("not done"), points, size, level, tasks)

    if not finished:
        return Tiles(_no_tiles(destinations), size, [0], k, max_distance, square, **bound)
    return Tiles(_fill(points, finished, levels, size), size, levels, k, max_distance, square, **bound)


def _capped_grid(seen: dict, cap: float) -> tuple[float, int]:
    """Coarsest cell size and how many cells the cap reaches.

    The size is the cap, or a half or a quarter of it where the destinations
    are so dense on average that coarser tiles would only be cut again.
    """
    area = max(seen["x1"] - seen["x0"], cap) * max(seen["y1"] - seen["y0"], cap)
    spacing = math.sqrt(area / seen["rows"])
    halvings = 0
    while halvings < 2 and cap / 2**halvings > 8 * spacing:
        halvings += 1
    return cap / 2**halvings, 2**halvings


def _with_kids(crowded: DataFrame, points: DataFrame, size: float, level: int,
               tasks: int) -> DataFrame:
    """Crowded tiles with the cells of their lists counted on the two finer grids."""
    cells = crowded.select("tx", "ty", F.inline("cells"))
    # Only the points in those cells are counted again.
    wanted = cells.select("qx", "qy").distinct()
    keyed = points.withColumns(
        {"qx": _cell(F.col("x"), size, level), "qy": _cell(F.col("y"), size, level)}
    )
    inside = keyed.join(wanted, ["qx", "qy"], "left_semi").select("x", "y", "n")
    counted = _nested_counts(inside, size, level)
    return (
        cells.select("tx", "ty", "qx", "qy")
        .join(counted, ["qx", "qy"])
        # Few bytes but much arithmetic per tile: the task count follows the
        # number of tiles, where AQE would go by bytes and merge the tasks.
        .repartition(tasks, "tx", "ty")
        .groupBy("tx", "ty")
        .agg(F.collect_list(F.struct("qx", "qy", "n", "kids")).alias("cells"))
    )


def _no_tiles(destinations: DataFrame) -> DataFrame:
    key_type = destinations.schema["destination"].dataType.simpleString()
    return destinations.sparkSession.createDataFrame(
        [],
        "level int, tx long, ty long, candidates "
        f"array<struct<destination: {key_type}, x: double, y: double>>",
    )


def _fill(points: DataFrame, finished: list[DataFrame], levels: list[int],
          size: float) -> DataFrame:
    """Replace the cells of finished tiles by the destinations in them."""
    leaves = finished[0]
    for f in finished[1:]:
        leaves = leaves.unionByName(f)
    leaves = leaves.select("level", "tx", "ty", F.inline("cells")).drop("n")
    keys = ", ".join(
        f"struct({level} as level, floor(x / {size!r}D * {float(SPLIT**level)!r}D) as qx, "
        f"floor(y / {size!r}D * {float(SPLIT**level)!r}D) as qy)"
        for level in levels
    )
    keyed = points.selectExpr("x", "y", "keys", f"inline(array({keys}))")
    filled = (
        leaves.join(keyed, ["level", "qx", "qy"])
        .select("level", "tx", "ty", F.explode("keys").alias("destination"), "x", "y")
        .groupBy("level", "tx", "ty")
        # In key order, so that the first of equally near candidates is the smallest key.
        .agg(F.sort_array(F.collect_list(F.struct("destination", "x", "y"))).alias("candidates"))
    )
    return materialize(filled, "tiles")
