"""Arithmetic of the nearest-neighbour search over leaves, for whole Arrow batches.

A leaf is a group of destinations that lie together, with the box around them;
leaves stand in slabs of ascending x, and in ascending y inside a slab. The
functions here look for leaves and measure distances; Spark decides what meets.

They travel to the workers by value, so the executors need no copy of this
package.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

from geonear.functions.ranking import k_smallest_bound

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAIRS = 1 << 17  # distances that are held at once: arrays of 1 MB, which stay in a core's cache


def leaf_index(slab, x0, x1, y0, y1, n):
    """Arrays of the leaves in slab order, and where each slab begins."""
    first = np.flatnonzero(np.r_[True, slab[1:] != slab[:-1]]) if len(slab) else np.zeros(0, np.int64)
    ends = np.r_[first[1:], len(slab)].astype(np.int64)
    wide = [np.minimum.reduceat(x0, first), np.maximum.reduceat(x1, first)] if len(slab) else [x0, x1]
    return {"first": first, "ends": ends, "sx0": np.maximum.accumulate(wide[0]), "sx1": np.maximum.accumulate(wide[1]),
            "x0": x0, "x1": x1, "y0": y0, "y1": y1, "n": n}


def _segment_search(values, lo, hi, wanted, inclusive):
    """Number of ``values[lo:hi]`` (ascending) below ``wanted`` (or equal, if inclusive), for every row."""
    lo, hi, base = lo.copy(), hi.copy(), lo
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo - base
        mid = (lo + hi) // 2
        at = values[np.minimum(mid, len(values) - 1)]
        right = open_ & ((at <= wanted) if inclusive else (at < wanted))
        lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)


def home_leaves(index, x, y):
    """The leaf of each point: that of its slab which begins last below it."""
    s = np.clip(np.searchsorted(index["sx0"], x, "right") - 1, 0, None)
    lo, hi = index["first"][s], index["ends"][s]
    return lo + np.clip(_segment_search(index["y0"], lo, hi, y, True) - 1, 0, None)


def spread(counts):
    """Row numbers and running numbers for ``counts`` items per row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def leaves_within(index, x, y, reach):
    """``(row, leaf)`` for all leaves whose box is at most ``reach`` from a point, in slices."""
    s0 = np.searchsorted(index["sx1"], x - reach, "left")
    s1 = np.searchsorted(index["sx0"], x + reach, "right")
    counts = np.maximum(s1 - s0, 0)
    for a, b in _runs(counts, PAIRS):
        row, k = spread(counts[a:b])
        row += a
        slab = s0[row] + k
        lo, hi = index["first"][slab], index["ends"][slab]
        i0 = _segment_search(index["y1"], lo, hi, y[row] - reach[row], False)
        i1 = _segment_search(index["y0"], lo, hi, y[row] + reach[row], True)
        inner = np.maximum(i1 - i0, 0)
        for c, d in _runs(inner, PAIRS):
            at, k = spread(inner[c:d])
            at += c
            r, leaf = row[at], lo[at] + i0[at] + k
            gx = np.maximum(np.maximum(index["x0"][leaf] - x[r], x[r] - index["x1"][leaf]), 0)
            gy = np.maximum(np.maximum(index["y0"][leaf] - y[r], y[r] - index["y1"][leaf]), 0)
            # Rounding is monotone, so no point of the box can come out nearer than this.
            near = np.sqrt(gx * gx + gy * gy) <= reach[r]
            yield r[near], leaf[near]


def _runs(sizes, limit):
    """Index ranges of consecutive rows of at most ``limit`` items in all; a larger row stands alone."""
    total = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + limit, "right")))
        yield start, end
        start = end


def far_bound(index, x, y, k):
    """A distance within which at least ``k`` destinations lie: the far corner of some leaf that has as many."""
    large = np.flatnonzero(index["n"] >= k)
    bound = np.full(len(x), np.inf)
    if len(large):
        step = max(1, PAIRS // len(large))
        for i in range(0, len(x), step):
            px, py = x[i:i + step, None], y[i:i + step, None]
            fx = np.maximum(np.abs(px - index["x0"][large]), np.abs(px - index["x1"][large]))
            fy = np.maximum(np.abs(py - index["y0"][large]), np.abs(py - index["y1"][large]))
            bound[i:i + step] = np.sqrt(fx * fx + fy * fy).min(axis=1)
    return bound


def nearest_in(x, y, row, leaf, starts, sizes, px, py, order, k, reach, square=None, ordered=True, slack=1.0,
               selected=True):
    """``(row, slot, distance)`` of the nearest points of the given leaves for each row.

    ``row`` ascends. A row's points are those of its leaves, ``starts`` and
    ``sizes`` giving their slots in ``px, py``. The ``k`` first by distance,
    then ``order``; with ``k`` 0 all up to ``slack`` times the smallest distance.
    Only distances up to ``reach`` of the row count, and with ``square`` only points within the
    square of that half-width. Unless ``ordered``, a row's points come as they
    stand, with all that tie for the last place; unless ``selected`` either, so may
    others within its reach, while they are few, for a selection among more of them.
    """
    out = []
    counts = sizes[leaf]
    last = np.flatnonzero(np.r_[row[1:] != row[:-1], True]) if len(row) else np.zeros(0, np.int64)
    first = np.r_[0, last[:-1] + 1] if len(last) else last
    per_row = np.add.reduceat(counts, first) if len(first) else counts
    for a, b in _runs(per_row, PAIRS):
        lo, hi = first[a], last[b - 1] + 1
        held, each, own = per_row[a:b], counts[lo:hi], row[first[a:b]]
        begin = np.cumsum(held) - held
        # A leaf's slots are consecutive, so rows are repeated rather than looked up for each pair.
        slot = np.repeat(starts[leaf[lo:hi]] - (np.cumsum(each) - each), each)
        slot += np.arange(len(slot))
        dx, dy = np.repeat(x[own], held), np.repeat(y[own], held)
        dx -= px[slot]
        dy -= py[slot]
        d = np.sqrt(dx * dx + dy * dy)
        near = d <= np.repeat(reach[own], held)
        if square is not None:
            near &= (np.abs(dx) <= square) & (np.abs(dy) <= square)
        if not (ordered or selected) and np.count_nonzero(near) <= 4 * max(k, 1) * len(held):
            bound = np.full(len(held), np.inf)
        elif k > 1:
            bound = k_smallest_bound(np.where(near, d, np.inf), begin, held, k)
        else:
            bound = np.full(len(held), -1.0)
            filled = held > 0
            if filled.any():
                bound[filled] = np.minimum.reduceat(np.where(near, d, np.inf), begin[filled]) * (1.0 if k else slack)
        hit = np.flatnonzero(near & (d <= np.repeat(bound, held)))
        near = np.repeat(own, held)[hit], slot[hit], d[hit]
        out.append(first_k(*near, order, k, slack) if ordered else near)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(parts) for parts in zip(*out))


def first_k(row, slot, d, order, k, slack=1.0):
    """The first ``k`` of each row by (distance, order); with ``k`` 0 all up to ``slack`` times its smallest distance."""
    by = np.lexsort((order[slot], d, row))
    row, slot, d = row[by], slot[by], d[by]
    if not len(row):
        return row, slot, d
    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    sizes = np.diff(np.r_[begin, len(row)])
    if k:
        keep = np.arange(len(row)) - np.repeat(begin, sizes) < k
    else:
        keep = d <= np.repeat(d[begin] * slack, sizes)
    return row[keep], slot[keep], d[keep]


def nearest_of(row, slot, d, k):
    """The ``k`` smallest distances of each row, with all that tie for the last place, in the order of rows."""
    by = np.argsort(row, kind="stable")
    row, slot, d = row[by], slot[by], d[by]
    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[begin, len(row)])
    keep = d <= np.repeat(k_smallest_bound(d, begin, sizes, k), sizes)
    return row[keep], slot[keep], d[keep]


def leading(found, first):
    """The ``first`` of each row of an ordered ``(row, slot, distance)``."""
    keep = np.arange(len(found[0])) - np.searchsorted(found[0], found[0]) < first
    return tuple(v[keep] for v in found)


def search_all(index, starts, sizes, px, py, order, x, y, k, cap, merged=True, square=None, first=None, slack=1.0):
    """``(row, slot, distance)`` over all leaves: first the one a point lies in, then those near enough to matter.

    Unless ``merged``, what the leaf of a point and the others hold isn't cut to
    the first ``k`` of both. ``square`` is as in :func:`nearest_in`; ``cap`` reaches its corners then.
    Of the ``k``, only the ``first`` are put in order and returned, if given. With ``k`` 0, all up
    to ``slack`` times the smallest distance.
    """
    some = merged and k > 1
    rows = np.arange(len(x))
    reach = np.full(len(x), np.inf if cap is None else cap)
    home = home_leaves(index, x, y)
    found = nearest_in(x, y, rows, home, starts, sizes, px, py, order, k, reach, square, not some, slack)
    reach = narrowed(index, x, y, found, k, reach, slack)
    parts = [found]
    for row, leaf in leaves_within(index, x, y, reach):
        other = leaf != home[row]
        row, leaf = row[other], leaf[other]
        by = np.argsort(row, kind="stable")
        parts.append(nearest_in(x, y, row[by], leaf[by], starts, sizes, px, py, order, k, reach, square, not some, slack,
                                not some))
    if not merged:
        row, slot, d = (np.concatenate(c) for c in zip(*parts))
        by = np.argsort(row, kind="stable")
        return row[by], slot[by], d[by]
    if some:
        found = tuple(np.concatenate(c) for c in zip(*parts))
        for most in sorted({k, min(first or k, k)}, reverse=True):
            found = nearest_of(*found, most)
        return first_k(*found, order, first or k)
    return first_k(*(np.concatenate(c) for c in zip(*parts)), order, k, slack) if len(parts) > 1 else found


def narrowed(index, x, y, found, k, reach, slack=1.0):
    """How far a better answer can be, given what the first leaf of each row held."""
    row, _, d = found
    need = max(k, 1)
    count = np.bincount(row, minlength=len(x))
    full = count >= need
    reach = reach.copy()
    held = np.flatnonzero(count)
    last = np.full(len(x), np.inf)
    if len(held):
        begin = (np.cumsum(count) - count)[held]
        last[held] = np.maximum.reduceat(d, begin) if k else np.minimum.reduceat(d, begin) * slack
    reach[full] = np.minimum(reach[full], last[full])
    # Only the last leaf of a slab can be too small; with a cap, that is the bound.
    poor = np.flatnonzero(~full & np.isinf(reach))
    if len(poor):
        reach[poor] = far_bound(index, x[poor], y[poor], need)
    return reach


def _interleave(a, b):
    """Morton code of two numbers below 2 to the 30."""
    code = np.zeros(len(a), np.int64)
    for shift, v in ((1, a), (0, b)):
        v = v.astype(np.int64)
        for s, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = (v | (v << s)) & mask
        code |= v << shift
    return code


def tile_interval(level, tx, ty, finest, bits):
    """Coarse cell and first Morton code of tiles, in units of the finest level (``bits`` per level and axis)."""
    up = bits * (finest - level)
    fx, fy = tx << up, ty << up
    mask = (1 << bits * finest) - 1
    return fx >> bits * finest, fy >> bits * finest, _interleave(fx & mask, fy & mask)


def interval_index(level, tx, ty, finest, bits):
    """Disjoint tiles of all levels, ordered along the curve of their coarse cell."""
    cx, cy, lo = tile_interval(level, tx, ty, finest, bits)
    by = np.lexsort((lo, cy, cx))
    cx, cy, lo, level = cx[by], cy[by], lo[by], level[by]
    new = np.r_[True, (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])] if len(cx) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    column = np.flatnonzero(np.r_[True, cx[first][1:] != cx[first][:-1]]) if len(first) else first
    return {"cx": cx[first][column], "column": np.r_[column, len(first)], "cy": cy[first],
            "cell": np.r_[first, len(cx)], "lo": lo, "level": level, "finest": finest, "bits": bits}


def tile_levels(index, x, y, size):
    """The level of the tile each point lies in, or -1: the last interval that begins at or before it."""
    finest, bits = index["finest"], index["bits"]
    scale = float(1 << bits * finest)
    cx, cy, code = tile_interval(np.int64(finest), *(np.floor(v / size * scale).astype(np.int64) for v in (x, y)), finest, bits)
    found = np.full(len(x), -1, np.int64)
    c = np.searchsorted(index["cx"], cx)
    at = np.flatnonzero((c < len(index["cx"])) & (index["cx"][np.minimum(c, len(index["cx"]) - 1)] == cx))
    lo, hi = index["column"][c[at]], index["column"][c[at] + 1]
    r = lo + _segment_search(index["cy"], lo, hi, cy[at], False)
    met = (r < hi) & (index["cy"][np.minimum(r, len(index["cy"]) - 1)] == cy[at])
    at, r = at[met], r[met]
    lo, hi = index["cell"][r], index["cell"][r + 1]
    t = lo + _segment_search(index["lo"], lo, hi, code[at], True) - 1
    inside = t >= lo
    at, t = at[inside], t[inside]
    level = index["level"][t]
    # Tiles may leave gaps: those without origins aren't kept.
    inside = code[at] - index["lo"][t] < np.int64(1) << 2 * bits * (finest - level)
    found[at[inside]] = level[inside]
    return found


def run_starts(run, cx, cy, lo):
    """First places of runs along the curves, in order."""
    by = np.lexsort((lo, cy, cx))
    return {"run": run[by], "places": _places(cx[by], cy[by], lo[by])}


def _places(cx, cy, lo):
    out = np.empty(len(lo), [("cx", np.int64), ("cy", np.int64), ("lo", np.int64)])
    out["cx"], out["cy"], out["lo"] = cx, cy, lo
    return out


def last_before(starts, at):
    """The run that begins last at or before each place; the first run for places before all."""
    cx, cy, lo = at
    wanted, places = _places(cx, cy, lo), starts["places"]
    low, high = np.zeros(len(lo), np.int64), np.full(len(lo), len(places))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        there = places[np.minimum(mid, len(places) - 1)]
        before = (there["cx"] < wanted["cx"]) | ((there["cx"] == wanted["cx"]) & (
            (there["cy"] < wanted["cy"]) | ((there["cy"] == wanted["cy"]) & (there["lo"] <= wanted["lo"]))))
        right = open_ & before
        low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
    return starts["run"][np.maximum(low - 1, 0)]
