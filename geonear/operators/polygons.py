"""Point-in-polygon join."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from geonear.functions.cells import cut_polygon
from geonear.functions.geometry import located
from geonear.session import scratch_path

#: Edges of a band, and of a cell, that cutting aims at.
EDGES_PER_BAND = 8
EDGES_PER_CELL = 4
#: Least numbers of bands and of cells in a band, so that small polygons have cells without edges too.
MIN_BANDS = 3
MIN_CELLS = 4
#: Edges are entered this share of a cell beyond their ends, so that rounding loses none.
PAD = 1e-6


def ring_edges(vertices: DataFrame) -> DataFrame:
    """Edges ``(name, x1, y1, x2, y2)`` of rings ``(name, ring, seq, x, y)``.

    The last vertex is joined to the first, unless the ring is closed already.
    """
    ring = vertices.groupBy("name", "ring").agg(
        F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("v")
    )
    edges = ring.select("name", "v", F.posexplode("v").alias("i", "a")).select(
        "name", "a", F.expr("v[(i + 1) % size(v)]").alias("b")
    )
    flat = edges.select(
        "name", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"),
        F.col("b.x").alias("x2"), F.col("b.y").alias("y2"),
    )
    return flat.where("x1 <> x2 or y1 <> y2")


@dataclass
class Polygons:
    """Polygons cut into bands and cells, stored on shared storage; serves any number of points."""

    boxes: DataFrame  # level, cx, cy: the cells of a polygon's box; its name, extent, band height and bands
    bands: DataFrame  # name, band: where its cells begin, their width and number
    cells: DataFrame  # name, band, cell: its corner, the parity there and the edges in it
    levels: list[int]


def _side(qx: str, qy: str, e: str = "e") -> str:
    """Positive if a point lies to the left of an edge, in its direction; 0 on its line."""
    return f"(({e}.x2 - {e}.x1) * ({qy} - {e}.y1) - ({e}.y2 - {e}.y1) * ({qx} - {e}.x1))"


def _left_of(qx: str, qy: str, e: str = "e") -> str:
    """Whether a ray from a point to the left crosses an edge (which has its lower end, not its upper one)."""
    side = _side(qx, qy, e)
    return (f"(({e}.y1 <= {qy} and {e}.y2 > {qy} and {side} < 0) or "
            f"({e}.y2 <= {qy} and {e}.y1 > {qy} and {side} > 0))")


def _above(qx: str, qy: str) -> str:
    """Whether an edge crosses the vertical through a point (just left of it) above the point."""
    side = _side(qx, qy)
    return (f"((e.x2 > e.x1 and {side} < 0) or (e.x2 < e.x1 and {side} > 0) or "
            f"({side} = 0 and (e.x2 - e.x1) * (e.y2 - e.y1) < 0))")


def _inside(x: str, y: str, corner_x: str, corner_y: str, odd: str, edges: str) -> str:
    """SQL for "inside": from the parity at the corner of a cell along its left side, then to the point.

    Only edges of the cell can lie in between: those that cross the left side
    between the corner and the height of the point, and those that the ray from
    the point crosses before it reaches the left side.
    """
    on_way = (f"((e.x1 < {corner_x}) <> (e.x2 < {corner_x}) and "
              f"{_above(corner_x, corner_y)} <> {_above(corner_x, y)})")
    flips = f"({_left_of(x, y)} <> {_left_of(corner_x, y)}) <> {on_way}"
    touching = (f"{_side(x, y)} = 0 and {x} between least(e.x1, e.x2) and greatest(e.x1, e.x2) "
                f"and {y} between least(e.y1, e.y2) and greatest(e.y1, e.y2)")
    return (f"case when size({edges}) = 0 then {odd} else exists({edges}, e -> {touching}) "
            f"or aggregate({edges}, {odd}, (odd, e) -> odd <> ({flips})) end")


def cut_polygons(edges: DataFrame) -> Polygons:
    """Cut polygons ``(name, x1, y1, x2, y2)`` for :func:`points_in_polygons`.

    A polygon is cut into bands of equal height, each band into cells of equal
    width. A cell holds the edges that reach into it and, of its lower left
    corner, whether that lies inside; a cell without edges is inside or outside
    as a whole, and outside ones aren't stored. There are as many bands and
    cells as give about ``EDGES_PER_CELL`` edges a cell, but never so many that
    the edges, cut by them, make more than a few times as many pieces: storage
    stays linear in the edges, whatever the sizes of the other polygons.

    The box of a polygon is entered in the cells of a grid at least as wide as
    the box, four at most; there is one grid per power of two in use. One task
    cuts one polygon, which is one value in its source.
    """
    name_type = edges.schema["name"].dataType
    double, long = T.DoubleType(), T.LongType()
    edge_type = T.ArrayType(T.StructType([T.StructField(c, double) for c in ("x1", "y1", "x2", "y2")]))
    fields = {
        "box": {"x0": double, "x1": double, "y0": double, "y1": double, "n_bands": long, "band_height": double,
                "level": T.IntegerType(), "cx": long, "cy": long},
        "band": {"band": long, "x_min": double, "x_max": double, "n_cells": long, "cell_width": double},
        "cell": {"band": long, "cell": long, "corner_x": double, "corner_y": double, "odd": T.BooleanType(), "edges": edge_type},
    }
    known = {"kind": T.StringType(), "name": name_type} | fields["box"] | fields["band"] | fields["cell"]
    schema = T.StructType([T.StructField(c, t) for c, t in known.items()])
    arrow = to_arrow_schema(schema)
    limits = (EDGES_PER_BAND, EDGES_PER_CELL, MIN_BANDS, MIN_CELLS, PAD)

    def cut(polygon: pa.Table) -> pa.Table:
        xy = [polygon.column(c).to_numpy().astype("f8") for c in ("x1", "y1", "x2", "y2")]
        box, bands, cells, sizes, edge = cut_polygon(*xy, *limits)
        side = max(box["x1"] - box["x0"], box["y1"] - box["y0"])
        level = math.ceil(math.log2(side)) if side > 0 else 0
        grid = [(cx, cy) for cx in range(*_cells_of(box["x0"], box["x1"], level))
                for cy in range(*_cells_of(box["y0"], box["y1"], level))]
        boxes = {c: [v] * len(grid) for c, v in box.items()} | {
            "level": [level] * len(grid), "cx": [c for c, _ in grid], "cy": [c for _, c in grid]}
        lists = pa.StructArray.from_arrays([pa.array(v[edge]) for v in xy], names=["x1", "y1", "x2", "y2"])
        cells["edges"] = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype("i4")), lists)
        name = polygon.column("name")[0]
        made = []
        for kind, rows in (("box", boxes), ("band", bands), ("cell", cells)):
            n = len(next(iter(rows.values())))
            own = {c: pa.array(v, arrow.field(c).type) if c != "edges" else v.cast(arrow.field(c).type) for c, v in rows.items()}
            own |= {"kind": pa.repeat(kind, n), "name": pa.repeat(name, n)}
            made.append(pa.table([own[f.name] if f.name in own else pa.nulls(n, f.type) for f in arrow], schema=arrow))
        return pa.concat_tables(made)

    def _cells_of(a: float, b: float, level: int) -> tuple[int, int]:
        return math.floor(a / 2.0**level), math.floor(b / 2.0**level) + 1

    spark, path, seen = edges.sparkSession, scratch_path(edges.sparkSession, "polygons"), Observation()
    edges.select("name", "x1", "y1", "x2", "y2").groupBy("name").applyInArrow(cut, schema).observe(
        seen, F.collect_set("level").alias("levels")).write.partitionBy("kind").parquet(path)
    levels = sorted(seen.get["levels"])
    parts = []
    for kind, own in fields.items():
        read = T.StructType([T.StructField(c, t) for c, t in ({"name": name_type} | own).items()])
        parts.append(spark.read.schema(read).parquet(f"{path}/kind={kind}") if levels else spark.createDataFrame([], read))
    return Polygons(*parts, levels)


def _at(n: str, place: Column) -> Column:
    """The number of the band or cell, of ``n``, at a place counted from the first one."""
    return F.greatest(F.lit(0), F.least(F.floor(place), F.col(n) - 1)).cast("long")


def points_in_polygons(points: DataFrame, polygons: DataFrame | Polygons) -> DataFrame:
    """Rows of ``points`` (with ``x``, ``y``) joined to each polygon holding them.

    ``polygons`` are edges ``(name, x1, y1, x2, y2)`` or the result of
    :func:`cut_polygons`; holes and several rings follow the even-odd rule, and
    the boundary counts as inside. Points without a position are in none.

    A point meets the boxes around it, by grid cell, then of each such polygon
    the band at its height and the cell at its place: equi-joins all, in which
    the points are the side that may be split where one cell holds very many of
    them. The few edges of the cell decide, and none where the cell has none.
    All of it is Spark expressions.
    """
    polygons = polygons if isinstance(polygons, Polygons) else cut_polygons(polygons)
    tagged = lambda d, tag: d.withColumnsRenamed({c: f"__{tag}_{c}" for c in d.columns})
    boxes, bands, cells = tagged(polygons.boxes, "p"), tagged(polygons.bands, "b"), tagged(polygons.cells, "c")
    keys = ", ".join(
        f"struct({level} as __p_level, floor(x / {2.0**level!r}D) as __p_cx, floor(y / {2.0**level!r}D) as __p_cy)"
        for level in polygons.levels
    ) or "struct(0 as __p_level, 0L as __p_cx, 0L as __p_cy)"
    near = (
        points.where(located("x") & located("y")).selectExpr("*", f"inline(array({keys}))")
        .join(boxes, ["__p_level", "__p_cx", "__p_cy"])
        .where("x between __p_x0 and __p_x1 and y between __p_y0 and __p_y1")
        .withColumn("__p_row", _at("__p_n_bands", (F.col("y") - F.col("__p_y0")) / F.col("__p_band_height")))
        .select(*points.columns, "__p_name", "__p_row")
    )
    met = near.join(
        bands, F.col("__p_name").eqNullSafe(F.col("__b_name")) & (F.col("__p_row") == F.col("__b_band"))
    ).where("x between __b_x_min and __b_x_max").withColumn(
        "__p_cell", _at("__b_n_cells", (F.col("x") - F.col("__b_x_min")) / F.col("__b_cell_width")))
    found = met.join(
        cells, F.col("__p_name").eqNullSafe(F.col("__c_name")) & (F.col("__p_row") == F.col("__c_band"))
        & (F.col("__p_cell") == F.col("__c_cell")))
    inside = _inside("x", "y", "__c_corner_x", "__c_corner_y", "__c_odd", "__c_edges")
    return found.where(inside).select(*points.columns, F.col("__p_name").alias("name"))
