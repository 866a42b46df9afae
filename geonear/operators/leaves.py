"""Leaves of destinations, and the search of nearest neighbours from the origins.

Destinations are packed into leaves, groups that lie together: Spark cuts them
into slabs by ranges of x, sorts each slab by y and takes runs of it. A leaf is
as small as its destinations lie close, so a tight cluster far away costs an
origin no more than any other place does: an origin looks at the leaf it lies
in, which bounds the distance of its k-th neighbour, and then only at leaves
whose box begins within that distance.

* While the destinations are few (``BROADCAST_KEYS``, counted; more if their keys are
  numbers), all leaves go to the executors and origins are searched where they are
  read, without any shuffle of origins or pairs.
* Beyond that only the boxes of the leaves go there, at most ``MAX_LEAVES``
  whatever the number of destinations. Distinct origin coordinates meet the
  leaf they lie in, as one group per leaf whose destinations are sent once; the
  coordinates that aren't settled by it meet the other leaves in reach, and
  Spark merges what a coordinate found. Crowded leaves are dealt over several
  groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from geonear.functions.geometry import located
from geonear.functions.search import (
    home_leaves,
    leading,
    leaf_index,
    leaves_within,
    narrowed,
    nearest_in,
    search_all,
)
from geonear.operators.tiles import _reduce_to_k
from geonear.session import materialize, materialize_measured

#: Destination keys up to which all of them are sent to every executor (some 100 bytes each).
BROADCAST_KEYS = 1_000_000
#: So many numbers (some 40 bytes each) take the place of one key.
NUMBER_KEYS = 3
#: Leaves whose boxes every executor gets (48 bytes each); larger tables have larger leaves.
MAX_LEAVES = 1 << 20
#: Origin coordinates that meet one leaf in one group.
GROUP_ROWS = 50_000
#: Bytes of origins below which a table may come in fewer partitions than there are cores.
SMALL_BYTES = 256 << 20
#: From the middle of a square to its corners, by its half-width; a little more, as distances are rounded.
CORNER = 2**0.5 * (1 + 1e-9)


@dataclass
class Leaves:
    """Leaves for one table of destinations and at most ``k`` neighbours."""

    table: DataFrame  # leaf, keys, xs, ys: in the order of keys
    index: dict  # boxes of all leaves, by functions.search.leaf_index
    ids: np.ndarray  # the leaves' ids, in that order
    k: int
    key_type: T.DataType
    whole: pa.Table | None  # the table itself while it is small


def build_leaves(destinations: DataFrame, k: int = 1, leaf_keys: int | None = None,
                 broadcast_keys: int | None = None) -> Leaves:
    """Leaves of ``destinations(destination, x, y)`` for up to ``k`` neighbours.

    Rows without a position are left out; a coordinate keeps its ``k`` smallest
    keys. ``leaf_keys`` is the number of keys of a leaf; it never limits a result.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    key_type = destinations.schema["destination"].dataType
    points, seen = materialize_measured(_reduce_to_k(destinations, k), "points", keys=F.sum("n"))
    total = seen["keys"] or 0
    most = BROADCAST_KEYS * (NUMBER_KEYS if isinstance(key_type, T.NumericType) else 1)
    small = total <= (most if broadcast_keys is None else broadcast_keys)
    size = max(leaf_keys or (max(16, 2 * k) if small else max(1024, 16 * k)), -(-total // MAX_LEAVES))
    slabs = max(1, round((total / size) ** 0.5))
    schema = T.StructType([
        T.StructField("leaf", T.LongType()),
        *[T.StructField(c, T.DoubleType()) for c in ("x0", "x1", "y0", "y1")],
        T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(key_type)),
        T.StructField("xs", T.ArrayType(T.DoubleType())), T.StructField("ys", T.ArrayType(T.DoubleType())),
    ])
    ordered = points.repartitionByRange(slabs, "x", "y").sortWithinPartitions("y", "x")
    packed = ordered.select("x", "y", "keys", F.spark_partition_id().alias("slab")).mapInArrow(_packer(size), schema)
    table = materialize(packed, "leaves")
    boxes = table.select("leaf", "x0", "x1", "y0", "y1", "n").toArrow().sort_by("leaf")
    ids, *rest = (boxes.column(c).to_numpy() for c in boxes.schema.names)
    whole = table.select("leaf", "keys", "xs", "ys").toArrow().sort_by("leaf") if small else None
    return Leaves(table.select("leaf", "keys", "xs", "ys"), leaf_index(ids >> 32, *rest), ids, k, key_type, whole)


def _packer(size: int):
    """Batches of a slab in the order of y -> its leaves, with keys in ascending order inside."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = 0, None

        def leaves(rows, ends):
            """One row for each leaf; a leaf ends before each of the rows ``ends``."""
            nonlocal made
            keys = rows.column("keys").combine_chunks()
            counts = pc.list_value_length(keys).to_numpy()
            rows_of = np.diff(np.r_[0, ends])
            leaf = np.repeat(np.repeat(np.arange(len(ends)), rows_of), counts)
            repeat = np.repeat(np.arange(len(keys)), counts)
            x, y = (rows.column(c).to_numpy() for c in ("x", "y"))
            flat = keys.flatten()
            by = pc.sort_indices(pa.table([pa.array(leaf), flat], names=["leaf", "key"]),
                                 sort_keys=[("leaf", "ascending"), ("key", "ascending")])
            at, begin = repeat[by.to_numpy()], np.r_[0, ends[:-1]]
            n = np.add.reduceat(counts, begin).astype("i8")
            offsets = pa.array(np.r_[0, np.cumsum(n)].astype("i4"))
            number = (rows.column("slab")[0].as_py() << 32) + made + np.arange(len(ends))
            made += len(ends)
            box = [f.reduceat(v, begin) for v in (x, y) for f in (np.minimum, np.maximum)]
            lists = [pa.ListArray.from_arrays(offsets, v) for v in (flat.take(by), pa.array(x[at]), pa.array(y[at]))]
            return pa.record_batch([pa.array(number, pa.int64()), *map(pa.array, box), pa.array(n), *lists],
                                   names=["leaf", "x0", "x1", "y0", "y1", "n", "keys", "xs", "ys"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            total = np.cumsum(pc.list_value_length(held.column("keys")).to_numpy())
            ends, done, last = [], 0, len(total)
            # A leaf is cut off only while another whole one stays, so none is much too small.
            while last and total[-1] - done >= 2 * size:
                cut = min(int(np.searchsorted(total, done + size)) + 1, last - 1)
                if ends and cut <= ends[-1] or not cut:
                    break
                ends.append(cut)
                done = total[cut - 1]
            if ends:
                yield leaves(held.slice(0, ends[-1]), np.array(ends))
                held = held.slice(ends[-1]).combine_chunks()
        if held is not None and len(held):
            yield leaves(held, np.array([len(held)]))

    return pack


def _near_type(key_type: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([
        T.StructField("distance", T.DoubleType()), T.StructField("destination", key_type),
        T.StructField("bx", T.DoubleType()), T.StructField("by", T.DoubleType())]))


def _listed():
    """``(row, slot, distance)`` in row order -> the rows' lists, as an Arrow array."""
    def lists(n, row, slot, d, keys, px, py):
        ends = np.cumsum(np.bincount(row, minlength=n))
        at = pa.array(slot)
        parts = [pa.array(d), keys.take(at), pa.array(px[slot]), pa.array(py[slot])]
        return pa.ListArray.from_arrays(
            pa.array(np.r_[0, ends].astype("i4")), pa.StructArray.from_arrays(parts, names=["distance", "destination", "bx", "by"]))

    return lists


def search_leaves(origins: DataFrame, leaves: Leaves, max_distance: float | None = None, ties: bool = False,
                  first: int | None = None, merged: bool = True, square: bool = False,
                  slack: float = 1.0) -> DataFrame:
    """``origin, x, y, nearest``: the ranked neighbours of each origin as an array, empty lists included.

    ``nearest`` is ``array<struct<distance, destination, bx, by>>`` with up to
    ``k`` entries within ``max_distance``, of which the ``first`` are kept, if
    given. With ``ties`` it holds all coordinates at the smallest distance, or up to
    ``slack`` times as far (with the smallest key of each). Origins without a position have an empty list.

    With ``merged=False`` the lists are of candidates, among which are the ones
    asked for: those of an origin's own leaf and of the others in reach aren't
    put together, and an origin may have several rows. With ``square`` the cap is
    the half-width of a square.
    """
    if max_distance is not None and max_distance <= 0:
        raise ValueError("max_distance must be positive")
    if square and max_distance is None:
        raise ValueError("a square needs a cap")
    if ties and leaves.k != 1:
        raise ValueError("ties are looked for among leaves of k=1")
    if slack < 1 or (slack > 1 and not ties):
        raise ValueError("slack is at least 1, and for ties only")
    seen = origins.select("origin", "x", "y")
    k, cap = (0 if ties else leaves.k), (None if max_distance is None else float(max_distance))
    half = cap if square else None
    if square:
        cap *= CORNER
    if not len(leaves.ids):
        return seen.withColumn("nearest", F.array().cast(_near_type(leaves.key_type)))
    if leaves.whole is not None:
        return _search_in_place(seen, leaves, k, cap, first, merged, half, slack)
    return _search_by_leaf(seen, leaves, k, cap, first, merged, half, slack)


def _spread(seen: DataFrame) -> DataFrame:
    """Over all cores, where Catalyst holds the table small and it isn't read in as many parts anyway."""
    cores, plan = seen.sparkSession.sparkContext.defaultParallelism, seen._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) >= SMALL_BYTES:
        return seen
    # Without an exchange, asking for the partition count runs nothing.
    scan = "Exchange" not in plan.executedPlan().toString()
    return seen if scan and plan.toRdd().getNumPartitions() >= cores else seen.repartition(cores)


def _search_in_place(seen: DataFrame, leaves: Leaves, k: int, cap: float | None, first: int | None,
                     merged: bool, half: float | None, slack: float) -> DataFrame:
    seen = _spread(seen)
    keys = leaves.whole.column("keys").combine_chunks()
    sizes = np.diff(keys.offsets.to_numpy())
    starts = np.cumsum(sizes) - sizes
    flat, px, py = (leaves.whole.column(c).combine_chunks().flatten() for c in ("keys", "xs", "ys"))
    px, py = px.to_numpy(), py.to_numpy()
    order = np.empty(len(flat), np.int64)
    order[pc.sort_indices(flat).to_numpy()] = np.arange(len(flat))
    index, lists = leaves.index, _listed()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_numpy(zero_copy_only=False).astype("f8") for c in ("x", "y"))
            at = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
            row, slot, d = search_all(index, starts, sizes, px, py, order, x[at], y[at], k, cap, merged, half, first,
                                      slack)
            if first:
                row, slot, d = leading((row, slot, d), first)
            yield pa.record_batch([*batch.columns, lists(len(x), at[row], slot, d, flat, px, py)],
                                  names=["origin", "x", "y", "nearest"])

    schema = T.StructType([*seen.schema.fields, T.StructField("nearest", _near_type(leaves.key_type))])
    return seen.mapInArrow(search, schema)


def _search_by_leaf(seen: DataFrame, leaves: Leaves, k: int, cap: float | None, first: int | None,
                    merged: bool, half: float | None, slack: float) -> DataFrame:
    index, ids, lists = leaves.index, leaves.ids, _listed()
    near_type = _near_type(leaves.key_type)
    spot = [T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_numpy() for c in ("x", "y"))
            reach = pa.array(np.full(len(x), np.inf if cap is None else cap))
            yield pa.record_batch([*batch.columns, pa.array(ids[home_leaves(index, x, y)]), reach],
                                  names=["x", "y", "leaf", "reach"])

    def met(left: pa.Table, right: pa.Table, home: bool) -> pa.Table:
        """Coordinates of a group against the destinations of its leaf."""
        x, y, reach = (left.column(c).to_numpy() for c in ("x", "y", "reach"))
        keys, px, py = (right.column(c).combine_chunks().flatten() for c in ("keys", "xs", "ys"))
        px, py = px.to_numpy(), py.to_numpy()
        rows, zero = np.arange(len(x)), np.zeros(len(x), np.int64)
        found = nearest_in(x, y, rows, zero, np.zeros(1, np.int64), np.array([len(px)]), px, py,
                           np.arange(len(px)), k, reach, half, slack=slack)
        # The first of all are among the first of each leaf: no more of them needs to be stored.
        near = lists(len(x), *(leading(found, first) if first else found), keys, px, py)
        if not home:
            return pa.table([left.column("x"), left.column("y"), near], names=["x", "y", "nearest"])
        reach = narrowed(index, x, y, found, k, reach, slack)
        others = [np.stack(part) for part in leaves_within(index, x, y, reach)]
        row, leaf = np.concatenate([np.zeros((2, 0), np.int64), *others], axis=1)
        leaf = ids[leaf]
        more = leaf != left.column("leaf").to_numpy()[row]
        row, leaf = row[more], leaf[more]
        by = np.argsort(row, kind="stable")
        ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(x)))].astype("i4")
        return pa.table([left.column("x"), left.column("y"), near, pa.array(reach),
                         pa.ListArray.from_arrays(pa.array(ends), pa.array(leaf[by]))],
                        names=["x", "y", "nearest", "reach", "others"])

    def meet(rows: DataFrame, home: bool) -> DataFrame:
        """Groups of coordinates and leaves, as many groups per leaf as its coordinates need."""
        crowded = rows.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_ROWS)
        parts = materialize(crowded.select("leaf", F.ceil(F.col("n") / GROUP_ROWS).alias("parts")), "crowded-leaves")
        share = F.coalesce(F.col("parts"), F.lit(1))
        left = rows.join(parts, "leaf", "left").withColumn("part", F.pmod(F.xxhash64("x", "y"), share)).drop("parts")
        right = leaves.table.join(parts, "leaf", "left").withColumn(
            "part", F.explode(F.sequence(F.lit(0).cast("long"), share - 1))).drop("parts")
        found = [*spot, T.StructField("nearest", near_type)]
        if home:
            found += [T.StructField("reach", T.DoubleType()), T.StructField("others", T.ArrayType(T.LongType()))]

        nothing = to_arrow_schema(T.StructType(found)).empty_table()

        def group(a: pa.Table, b: pa.Table) -> pa.Table:
            return met(a, b, home) if len(a) else nothing

        return left.groupBy("leaf", "part").cogroup(right.groupBy("leaf", "part")).applyInArrow(group, T.StructType(found))

    spots = seen.where(located("x") & located("y")).select(
        F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct()
    placed = materialize(spots.mapInArrow(place, T.StructType([
        *spot, T.StructField("leaf", T.LongType()), T.StructField("reach", T.DoubleType())])), "origin-leaves")
    home = materialize(meet(placed, True), "home-leaves")
    kept = min(k, first or k)
    settled, open_ = home.where("size(others) = 0").select("x", "y", "nearest"), home.where("size(others) > 0")
    if kept:
        settled = settled.withColumn("nearest", F.slice("nearest", 1, kept))
    further = meet(open_.select("x", "y", "reach", F.explode("others").alias("leaf")), False)
    # The order (distance, destination) is that of the struct. An origin looks at few leaves,
    # so these are few short lists.
    found = open_.select("x", "y", "nearest").unionByName(further)
    if not merged:
        return seen.join(settled.unionByName(found), ["x", "y"]).select("origin", "x", "y", "nearest")
    together = found.groupBy("x", "y").agg(F.array_sort(F.flatten(F.collect_list("nearest"))).alias("nearest"))
    first_ones = F.slice("nearest", 1, kept) if kept else F.filter(
        "nearest", lambda m: m["distance"] <= F.col("nearest")[0]["distance"] * slack)
    unsettled = together.withColumn("nearest", first_ones)
    answers = materialize(settled.unionByName(unsettled), "nearest")
    empty = F.array().cast(near_type)
    return seen.join(answers, ["x", "y"], "left").select("origin", "x", "y", F.coalesce("nearest", empty).alias("nearest"))
