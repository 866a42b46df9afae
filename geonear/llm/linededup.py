"""Line dedup by site-relative frequency, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geonear.llm.common import OWN, with_text

#: Share of a site's pages above which a line is boilerplate, and the number
#: of its pages that must carry it at least.
MAX_RATIO = 0.1
MIN_PAGES = 10

_KEY, _SITE, _PAGE, _DROP = f"{OWN}key", f"{OWN}site", f"{OWN}page", f"{OWN}drop"


def site_of(host: Column) -> Column:
    """A site name that is never null; a null host is a site of its own."""
    return F.coalesce(F.concat(F.lit("h"), host.cast("string")), F.lit(""))


def _digest(*parts: Column) -> Column:
    # 128 bits; the length in front keeps the parts apart.
    framed = [x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)]
    return F.unhex(F.md5(F.concat(*framed)))


def _line(x: Column) -> Column:
    return F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate_lines(docs: DataFrame, host: Column, text_col: str = "text",
                      max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Lines above the ratio: ``site, line_key, pages, total, ratio``.

    A page counts once for a line however often it repeats it, and counts in
    its site's total even if its text is null. Rows are pages; repeated rows
    are pages too. Lines are compared without white space at either end.
    """
    pages = docs.select(site_of(host).alias("site"), F.col(text_col).alias("text"))
    totals = pages.groupBy("site").agg(F.count("*").alias("total"))
    # Distinct within the page first, so that the count needs no distinct.
    keys = F.array_distinct(F.transform(F.filter(F.transform(_lines(F.col("text")), _line),
                                                 lambda l: l != ""), lambda l: _digest(F.col("site"), l)))
    counts = (
        pages.select("site", F.explode(keys).alias("line_key"))
        .groupBy("site", "line_key").agg(F.count("*").alias("pages"))
        .where(F.col("pages") >= min_pages)
    )
    return (
        counts.join(totals, "site")
        .withColumn("ratio", F.col("pages") / F.col("total"))
        .where(F.col("ratio") > max_ratio)
    )


def line_dedup(
    docs: DataFrame,
    host: Column | None = None,
    text_col: str = "text",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """``docs`` with the boilerplate lines of each site cut from its texts.

    A line goes if more than ``max_ratio`` of its site's pages, and at least
    ``min_pages`` of them, carry it. All of a page's occurrences go; other
    lines stay as they are and in order, blank ones too. Adds the columns
    ``n_lines`` and ``n_dropped`` in place of any of those names, keeps every
    row and other column, and sets ``n_chars`` if there is one. A null text
    stays null and has no lines; null hosts form one site.

    Only hashes are shuffled for counting. Lines meet the boilerplate lines by
    key (Spark broadcasts those while they are small, and splits a hot line
    beyond), which leaves a short list of positions per distinct page; whole
    texts move at most once.
    """
    host = F.col("source") if host is None else host
    found = boilerplate_lines(docs, host, text_col, max_ratio, min_pages).select(
        F.col("line_key").alias(_KEY))
    text = F.col(text_col)
    pages = docs.withColumn(_SITE, site_of(host)).withColumn(_PAGE, _digest(F.col(_SITE), F.coalesce(text, F.lit(""))))
    placed = pages.select(
        _PAGE, _SITE, F.posexplode(F.transform(_lines(text), _line)).alias("pos", "line")
    ).where("line <> ''").select(_PAGE, "pos", _digest(F.col(_SITE), F.col("line")).alias(_KEY))
    # Copies of a page in one site share their positions; a set holds them once.
    drops = placed.join(found, _KEY).groupBy(_PAGE).agg(F.collect_set("pos").alias(_DROP))
    met = pages.join(drops, _PAGE, "left")
    kept = F.filter(_lines(text), lambda l, i: ~F.array_contains(F.col(_DROP), i))
    counted = met.withColumns({
        f"{OWN}n": F.when(text.isNull(), 0).otherwise(F.size(_lines(text))),
        f"{OWN}d": F.when(F.col(_DROP).isNull(), 0).otherwise(F.size(_DROP)),
    })
    out = with_text(
        counted, F.when(F.col(_DROP).isNull(), text).otherwise(F.array_join(kept, "\n")), text_col)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*names, F.col(f"{OWN}n").alias("n_lines"), F.col(f"{OWN}d").alias("n_dropped"))
