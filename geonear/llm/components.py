"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geonear.session import materialize_measured

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; the root is the smallest node reached.

    Alternates two steps: each node hangs its larger neighbours, then its
    smaller ones, on the smallest node it knows. Components become stars in a
    number of rounds that grows with the logarithm of the nodes. Every round is
    written to shared storage, which cuts the lineage; nothing but two sums of
    a round reaches the driver. Loops and repeated edges are allowed.
    """
    state = dict(n=F.count("*"), s=F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")))
    now, seen = materialize_measured(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b").distinct(), label, **state)
    for _ in range(MAX_ROUNDS):
        if not seen["n"]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Here every edge leads from a node to a smaller one.
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                              F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.*").where("a <> b").distinct()
        now, then = materialize_measured(small, label, **state)
        if then == seen:
            break
        seen = then
    else:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
