"""Cutting one polygon into bands and cells, in arrays over its edges.

The functions travel to the workers by value, so the executors need no copy of
this package.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

from geonear.functions.search import spread

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def left_of(qx, qy, x1, y1, x2, y2):
    """Whether a ray from a point to the left crosses an edge (which has its lower end, not its upper one)."""
    side = (x2 - x1) * (qy - y1) - (y2 - y1) * (qx - x1)
    return ((y1 <= qy) & (y2 > qy) & (side < 0)) | ((y2 <= qy) & (y1 > qy) & (side > 0))


def _number(place, n):
    """The number of the band or cell, of ``n``, at a place counted from the first one."""
    return np.clip(np.floor(place), 0, n - 1).astype(np.int64)


def cut_polygon(x1, y1, x2, y2, per_band, per_cell, min_bands, min_cells, pad):
    """Box, bands and cells of a polygon.

    A band has its height, the range of x of the edges there and a number of
    equal cells; a cell has its lower left corner, the parity there, and the
    numbers of the edges that reach into it. Cells outside aren't returned.
    """
    n = len(x1)
    low, high = np.minimum(y1, y2), np.maximum(y1, y2)
    bottom, height, climb = low.min(), high.max() - low.min(), (high - low).sum()
    n_bands = max(min_bands, int(min(n / per_band, n * height / climb)) if climb > 0 else min_bands)
    h = height / n_bands if height > 0 else 1.0
    row_low, row_high = (_number((v - bottom) / h + s * pad, n_bands) for v, s in ((low, -1), (high, 1)))
    # A piece is an edge in a band, with the x it spans there.
    edge, k = spread(row_high - row_low + 1)
    band = row_low[edge] + k
    corner_y = bottom + band * h
    a, b, c, d = x1[edge], y1[edge], x2[edge], y2[edge]
    ends = []
    for y, flat in ((corner_y - pad * h, a), (corner_y + (1 + pad) * h, c)):
        share = np.divide(np.clip(y, low[edge], high[edge]) - b, d - b, out=np.zeros(len(b)), where=d != b)
        ends.append(np.where(d != b, a + share * (c - a), flat))
    left, right = np.minimum(*ends), np.maximum(*ends)

    count = np.bincount(band, minlength=n_bands)
    x_min, x_max = np.full(n_bands, np.inf), np.full(n_bands, -np.inf)
    np.minimum.at(x_min, band, left)
    np.maximum.at(x_max, band, right)
    held = np.flatnonzero(count)
    slack = np.where(count > 0, 1e-9 * (np.abs(x_min) + np.abs(x_max)), 0)
    x_min, x_max = x_min - slack, x_max + slack
    width = np.where(count > 0, x_max - x_min, 0)
    run = np.bincount(band, right - left, minlength=n_bands)
    fits = np.divide(count * width, run, out=count.astype("f8"), where=run > 0)
    n_cells = np.where(count > 0, np.maximum(min_cells, np.minimum(count / per_cell, fits).astype(np.int64)), 0)
    w = np.where(width > 0, width / np.maximum(n_cells, 1), 1.0)
    first = np.cumsum(n_cells) - n_cells  # number of the band's first cell among all

    from_cell = _number((left - x_min[band]) / w[band] - pad, n_cells[band])
    to_cell = _number((right - x_min[band]) / w[band] + pad, n_cells[band])
    piece, k = spread(to_cell - from_cell + 1)
    cell = first[band[piece]] + from_cell[piece] + k
    by = np.argsort(cell, kind="stable")
    sizes = np.bincount(cell, minlength=int(n_cells.sum()))

    # An edge at the height of the corners counts for all corners to the right of it: from which cell
    # on is asked of the test itself, at the corners around the quotient.
    spans = np.flatnonzero((b <= corner_y) != (d <= corner_y))
    a, b, c, d, at = a[spans], b[spans], c[spans], d[spans], band[spans]
    y = corner_y[spans]
    near = np.floor((a + (y - b) / (d - b) * (c - a) - x_min[at]) / w[at]).astype(np.int64)
    begin = near + 2
    for i in (1, 0, -1):
        begin = np.where(left_of(x_min[at] + (near + i) * w[at], y, a, b, c, d), near + i, begin)
    begin = np.maximum(begin, 0)
    inner = begin < n_cells[at]
    begun = np.bincount(first[at[inner]] + begin[inner], minlength=len(sizes))
    total = np.r_[0, np.cumsum(begun)]
    of = np.repeat(np.arange(n_bands), n_cells)
    odd = (total[1:] - total[first[of]]) % 2 == 1
    kept = np.flatnonzero(odd | (sizes > 0))
    number = kept - first[of[kept]]
    box = {"x0": np.minimum(x1, x2).min(), "x1": np.maximum(x1, x2).max(), "y0": bottom, "y1": high.max(),
           "n_bands": n_bands, "band_height": h}
    bands = {"band": held, "x_min": x_min[held], "x_max": x_max[held], "n_cells": n_cells[held], "cell_width": w[held]}
    cells = {"band": of[kept], "cell": number, "corner_x": x_min[of[kept]] + number * w[of[kept]],
             "corner_y": bottom + of[kept] * h, "odd": odd[kept]}
    return box, bands, cells, sizes[kept], edge[piece[by]]
