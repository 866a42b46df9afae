"""Planar hexagonal cells in axial coordinates (flat, metre-based; not H3 ids)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean edge length in metres of the published resolution-9 hexagons.
RES9_EDGE = 200.8


def hex_cell(x: Column, y: Column, edge: float) -> Column:
    """``struct<q, r>`` of the pointy-top hexagon with side ``edge`` holding (x, y).

    Fractional axial coordinates are rounded in cube space: the coordinate with
    the largest rounding error is recomputed from the other two.
    """
    s = F.lit(float(edge))
    root3 = F.lit(math.sqrt(3.0))
    fq = (root3 / 3.0 * x - y / 3.0) / s
    fr = (y * (2.0 / 3.0)) / s
    fs = -fq - fr
    q, r, t = (F.floor(v + 0.5) for v in (fq, fr, fs))
    eq, er, es = F.abs(q - fq), F.abs(r - fr), F.abs(t - fs)
    fix_q = (eq > er) & (eq > es)
    fix_r = ~fix_q & (er > es)
    return F.struct(
        F.when(fix_q, -r - t).otherwise(q).alias("q"),
        F.when(fix_r, -q - t).otherwise(r).alias("r"),
    )


def hex_disk(cell: Column, k: int) -> Column:
    """Array of the cells at most ``k`` steps from ``cell`` (3k² + 3k + 1 of them)."""
    steps = F.array(
        *[
            F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"))
            for i in range(-k, k + 1)
            for j in range(-k, k + 1)
            if abs(i + j) <= k
        ]
    )
    return F.transform(
        steps,
        lambda s: F.struct((cell["q"] + s["i"]).alias("q"), (cell["r"] + s["j"]).alias("r")),
    )


def hex_steps(a: Column, b: Column) -> Column:
    """Grid distance between two cells."""
    dq, dr = a["q"] - b["q"], a["r"] - b["r"]
    return F.greatest(F.abs(dq), F.abs(dr), F.abs(dq + dr))


def disk_reach(edge: float, k: int) -> float:
    """No point of the ``k``-disk around a point's cell is farther from it than this."""
    return (math.sqrt(3.0) * k + 2.0) * edge * (1 + 1e-9)
