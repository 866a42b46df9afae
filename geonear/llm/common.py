"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that count as white space wherever a pattern says so.
SPACES = r"[\x20\x09-\x0D]+"

#: Prefix of columns an operator adds for itself, so that no input column clashes.
OWN = "__llm_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """A string column as Python strings, null as the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def runs(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive items of at most ``limit`` in total.

    An item above the limit makes a range of its own: it is never cut.
    """
    start, held, i = 0, 0, -1
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if i >= start:
        yield start, i + 1


def slices_of(batches: Iterator[pa.RecordBatch], name: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of one string or binary column.

    A worker then holds the results of one such slice, not of a whole batch. A
    longer value makes a batch of its own.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_pylist()
        for a, b in runs(sizes, limit):
            yield batch.slice(a, b - a)


def with_fields(df: DataFrame, **fields: T.DataType) -> T.StructType:
    """The schema of ``df`` with fields added, all nullable."""
    kept = [T.StructField(f.name, f.dataType, True) for f in df.schema.fields]
    return T.StructType(kept + [T.StructField(n, t, True) for n, t in fields.items()])


def with_text(docs: DataFrame, text: Column, text_col: str = "text",
              size_col: str = "n_chars") -> DataFrame:
    """``docs`` with a new text, and its length where the table carries one."""
    changed = {text_col: text}
    out = docs.withColumns(changed)
    return out.withColumn(size_col, F.length(text_col).cast("long")) if size_col in docs.columns else out
