"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geonear.llm.common import OWN
from geonear.llm.linededup import site_of
from geonear.session import materialize, materialize_measured

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix for every word of the corpus.
SHARE = 1.5
#: Copies of a document in the mix, at most.
MAX_COPIES = 2
#: Steps of a preference; see :func:`variety`.
STEPS = 16
#: Rows of one source around its cut that meet in one window, at most.
WINDOW_ROWS = 20_000
#: Columns that :func:`mix_sources` adds, in place of any of those names.
ADDED = ("size", "source_size", "target", "inclusion", "copies", "taken")

_DIGIT = 13  # bits of the order that one round of the search for a cut reads
_DIGITS = 4  # of each of the three parts of the order
_BITS = _DIGIT * _DIGITS
_KEY, _STEP, _WORDS, _PART, _WHOLE, _REST, _AT, _CUT, _BEFORE = (
    OWN + c for c in ("source", "step", "words", "part", "whole", "rest", "at", "cut", "before"))
_ORDER = tuple(f"{OWN}order{i}" for i in range(3))


def words(text: Column) -> Column:
    """The words of a text, an empty list for null."""
    found = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def variety(found: Column) -> Column:
    """Share of different ones among words, in steps of 1 to ``STEPS``; 0 without words.

    Pages that repeat few words over and over are the last to get a further copy.
    """
    share = F.try_divide(F.lit(STEPS) * F.size(F.array_distinct(found)), F.size(found))
    return F.coalesce(F.ceil(share).cast("int"), F.lit(0))


def mix_sources(
    docs: DataFrame,
    source: Column | None = None,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    max_copies: int = MAX_COPIES,
    preference: Callable[[Column], Column] = variety,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] | None = None,
    seed: str = "mix",
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with the copies each has in the mix.

    The size of a document is its number of words. The mix has ``share`` times
    the words of all documents; sources divide it by ``weights``, which repeat
    over the sources in the order of their names (code points, null last). No
    source takes more than ``max_copies`` times its size; what exceeds that is
    divided among the others by weight until none is above.

    Within a source every document gets the same whole number of certain
    copies. The words that are left go to single further copies: the preference
    (an integer up to ``STEPS``, of the list of words) gives each document its
    probability of one, and the source's documents are ranked by random odds
    divided by these odds (Pareto order sampling). The ranking is cut where the
    words so far are nearest to the words that are left, so a source misses its
    target by half a document at most.

    Adds ``size``, ``source_size``, ``target`` (both in words, of the source),
    ``inclusion`` (probability of the further copy), ``copies`` and ``taken``
    (words), in place of any columns of these names. Every row stays. A null
    text, and one without words, has size 0 and no copies; null sources are one
    source. Random numbers follow from ``seed`` and the id; rows of one id are
    told apart by their texts, and equal rows are exchangeable, so reruns
    agree. An empty table gives an empty one.

    No source meets in one task: the cut is found on sums over slices of the
    order, finer in every round, until the slice that holds it has at most
    ``window_rows`` rows; only those rows are ranked in a window.
    """
    source = F.col("source") if source is None else source
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    text, mask = F.col(text_col), F.lit((1 << _BITS) - 1)
    drawn = F.conv(F.substring(F.md5(F.concat(
        F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, _BITS // 4), 16, 10).cast("long")
    listed = docs.select(*kept, site_of(source).alias(_KEY), words(text).alias(_WORDS), drawn.alias(_ORDER[0]),
                         F.xxhash64(text).bitwiseAND(mask).alias(_ORDER[1]),
                         F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(mask).alias(_ORDER[2]))
    # Stored once: the row numbers in the order's last part must not change between readers.
    stored = materialize(listed.select(
        *kept, _KEY, F.size(_WORDS).cast("long").alias("size"), preference(F.col(_WORDS)).alias(_STEP), *_ORDER,
    ), "mix-documents")
    steps = materialize(stored.groupBy(_KEY, _STEP).agg(F.sum("size").alias(_WORDS)), "mix-steps")
    plan = _inclusion(steps, _targets(steps, weights, share, max_copies))
    placed = stored.join(plan, [_KEY, _STEP]).withColumn(_ORDER[0], _pareto(F.col(_ORDER[0]), F.col("inclusion")))
    return _cut(placed, window_rows).select(
        *kept, "size", "source_size", "target", "inclusion", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def expand_mix(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it has copies, numbered by ``copy`` from 1."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1, cast(copies as int))")))


def _targets(steps: DataFrame, weights: Sequence[int], share: float, max_copies: int) -> DataFrame:
    """One row per source: its size and target in words."""
    by_name = [(F.col(_KEY) == "").alias("n"), F.col(_KEY)]
    sizes = steps.groupBy(_KEY).agg(F.sum(_WORDS).alias("source_size"))
    # Places in the order of names without one task for all of them: sorted
    # ranges, then the numbers of sources in the ranges before.
    ranges = materialize(sizes.repartitionByRange(*by_name).withColumn(_PART, F.spark_partition_id()), "mix-sources")
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.groupBy(_PART).agg(F.count("*").alias("n")).select(
        _PART, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(_BEFORE))
    nth = F.row_number().over(Window.partitionBy(_PART).orderBy(*by_name)) - 1 + F.col(_BEFORE)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    sources = materialize(
        ranges.join(before, _PART).select(_KEY, "source_size", weight.cast("long").alias("w")), "mix-weights")
    cap = F.col("source_size") * max_copies
    level, free = 0.0, None
    # Words per unit of weight rise until no further source meets its cap.
    while True:
        capped = cap <= F.lit(level) * F.col("w")
        seen = sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"), F.count_if(~capped).alias("free"),
            F.coalesce(F.sum(F.when(capped, cap)), F.lit(0)).alias("caps"),
            F.coalesce(F.sum(F.when(~capped, F.col("w"))), F.lit(0)).alias("w")).first()
        if not seen["w"] or seen["free"] == free:
            break
        free, level = seen["free"], (share * seen["total"] - seen["caps"]) / seen["w"]
    target = F.when(cap <= F.lit(level) * F.col("w"), cap.cast("double")).otherwise(F.col("w") * F.lit(level))
    return sources.select(_KEY, "source_size", target.alias("target"))


def _inclusion(steps: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source and step: certain copies, and the probability of one more.

    Probabilities are in proportion to the steps but 1 at most: the upper steps
    that reach it leave the other steps fewer words to share.
    """
    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    known = steps.join(targets, _KEY).withColumn(_WHOLE, whole).withColumn(
        _REST, F.greatest(F.lit(0.0), F.col("target") - F.col(_WHOLE) * F.col("source_size")))
    down = Window.partitionBy(_KEY).orderBy(F.desc(_STEP))
    above = F.coalesce(F.sum(_WORDS).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = F.sum(F.col(_STEP) * F.col(_WORDS)).over(down.rowsBetween(0, Window.unboundedFollowing))
    rate = F.try_divide(F.col(_REST) - above, here)
    ruled = known.withColumn("rate", rate).withColumn("rate", F.max_by(
        "rate", F.when(F.col("rate") * F.col(_STEP) <= 1, F.col(_STEP))).over(Window.partitionBy(_KEY)))
    inclusion = F.when(F.col(_STEP) == 0, 0.0).otherwise(
        F.least(F.lit(1.0), F.coalesce("rate", F.lit(1.0)) * F.col(_STEP)))
    return materialize(ruled.select(
        _KEY, _STEP, "source_size", "target", _WHOLE, _REST, inclusion.alias("inclusion")), "mix-plan")


def _pareto(drawn: Column, p: Column) -> Column:
    """Place in the Pareto order, below 2 to the power ``_BITS``: random odds over inclusion odds."""
    u = (drawn + 0.5) / float(1 << _BITS)
    q = u / (1 - u) / (p / (1 - p))
    place = F.least(F.floor(q / (1 + q) * float(1 << _BITS)), F.lit((1 << _BITS) - 1))
    return F.when(p >= 1, 0).when(p <= 0, (1 << _BITS) - 1).otherwise(place).cast("long")


def _prefix(depth: int) -> Column:
    """The first ``depth`` digits of a row's place in the order."""
    shifts = [_BITS - _DIGIT * min(max(depth - _DIGITS * i, 0), _DIGITS) for i in range(len(_ORDER))]
    return F.struct(*[F.shiftright(o, s).alias(o) for o, s in zip(_ORDER, shifts)])


def _cut(placed: DataFrame, window_rows: int) -> DataFrame:
    """``copies`` of all rows: certain ones, and one more before the cut of the source."""
    along = Window.partitionBy(_KEY).orderBy(_AT).rowsBetween(Window.unboundedPreceding, -1)
    cut, depth = None, 0
    while True:
        depth += 1
        inside = placed if cut is None else placed.withColumn(_CUT, _prefix(depth - 1)).join(
            cut.select(_KEY, _CUT, _BEFORE), [_KEY, _CUT])
        base = F.lit(0) if cut is None else F.max(_BEFORE)
        slices = inside.groupBy(_KEY, _prefix(depth).alias(_AT)).agg(
            F.sum("size").alias(_WORDS), F.count("*").alias("n"), F.max(_REST).alias(_REST), base.alias("base"))
        begun = slices.withColumn(_BEFORE, F.col("base") + F.coalesce(F.sum(_WORDS).over(along), F.lit(0)))
        here = (F.col(_REST) > 0) & (F.col(_BEFORE) <= F.col(_REST)) & (F.col(_BEFORE) + F.col(_WORDS) > F.col(_REST))
        cut, seen = materialize_measured(
            begun.where(here).select(_KEY, F.col(_AT).alias(_CUT), _BEFORE, "n"), "mix-cut", n=F.max("n"))
        if (seen["n"] or 0) <= window_rows or depth == _DIGITS * len(_ORDER):
            break
    met = placed.withColumn(_AT, _prefix(depth)).join(cut.drop("n"), _KEY, "left")
    # A source has no cut if no words are left to share, or more than it holds.
    sure = met.where(F.col(_CUT).isNull() | (F.col(_AT) != F.col(_CUT))).withColumn(
        "more", F.when(F.col(_CUT).isNull(), F.col(_REST) > 0).otherwise(F.col(_AT) < F.col(_CUT)))
    ranked = Window.partitionBy(_KEY).orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col(_BEFORE) + F.coalesce(F.sum("size").over(ranked), F.lit(0))
    near = met.where(F.col(_AT) == F.col(_CUT)).withColumn(
        "more", 2 * reached + F.col("size") <= 2 * F.col(_REST))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col(_WHOLE) + F.col("more").cast("long")).cast("long")
    return sure.unionByName(near).withColumn("copies", copies)
