"""Exact duplicates by content hash, with the bytes compared inside each group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geonear.llm.common import SPACES


def normalised(text: Column) -> Column:
    """The text two rows must share to be equal: white space runs become one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    content_hash: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Rows are grouped by a 128-bit content hash (``content_hash``) *and* by the
    text's bytes, so texts whose hashes collide are never taken for copies. Of
    each group the row with the smallest id stays. The grouping combines
    before its shuffle, so any number of copies sends one row per task; only
    ids and hashes meet the groups of several rows again, and that join may be
    split where one group is large.

    A null text counts as empty. A null id never wins over another id; a group
    of null ids only has a null ``keep_id`` and keeps them. Rows that repeat
    the smallest id of their group all count in ``group_size`` and are kept.
    Other columns are ignored.
    """
    text = normalised(F.col(text_col))
    keyed = docs.select(
        F.col(id_col).alias("doc_id"), content_hash(text).alias("h"),
        F.sha2(text, 256).alias("text_sha256"), text.alias("norm"),
    )
    groups = keyed.groupBy("h", "text_sha256", "norm").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    # The strong digest takes the place of the text where ids meet groups.
    several = groups.where("group_size > 1").drop("norm")
    return (
        keyed.drop("norm")
        .join(several, ["h", "text_sha256"], "left")
        .select(
            "doc_id",
            F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            F.when(F.col("group_size").isNull(), F.lit(True))
            .otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            "text_sha256",
        )
    )
