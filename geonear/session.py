"""Shared-storage helpers: where intermediate tables go and how lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_local_scratch: str | None = None


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder: ``spark.checkpoint.dir``, or the context's own.

    Only a local-mode session may go without the setting; it then gets one
    temporary folder per Python process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    global _local_scratch
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="geonear-")
    return _local_scratch


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the checkpoint folder, never used before."""
    return f"{checkpoint_root(spark)}/geonear/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table on shared storage and read it back.

    The result has no lineage, survives lost executors, and its size on disk
    is what Catalyst uses when it decides whether a join side is small enough
    to broadcast.
    """
    return materialize_measured(df, label)[0]


def materialize_measured(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """:func:`materialize`, plus aggregates gathered by the same job."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    schema = df.schema
    found: dict = {}
    if metrics:
        seen = Observation()
        df.observe(seen, *[m.alias(name) for name, m in metrics.items()]).write.parquet(path)
        found = seen.get
    else:
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path), found
