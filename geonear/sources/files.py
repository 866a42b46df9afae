"""Reading and writing point tables and results: CSV, pipe-separated text, ORC, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geonear.functions.codec import encode_wkb, encode_wkt

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("origin", T.LongType()),
        T.StructField("destination", T.StringType()),
        T.StructField("distance", T.DoubleType()),
    ]
)


# --- CSV -------------------------------------------------------------------


def read_points_csv(spark: SparkSession, path: str, x: str = "X_COORDINATE",
                    y: str = "Y_COORDINATE") -> DataFrame:
    """CSV with a header; every column is text, except ``x`` and ``y`` as double.

    No schema is inferred, so the data is read once only.
    """
    raw = spark.read.option("header", True).csv(path)
    return raw.withColumns({x: F.col(x).cast("double"), y: F.col(y).cast("double")})


def read_points_psv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """``|``-separated text without header; columns named and typed by position."""
    return spark.read.schema(schema).option("sep", "|").option("header", False).csv(path)


def export_points_psv(df: DataFrame, path: str, x: str = "x", y: str = "y") -> None:
    """``|``-separated text without header, with the point's WKT as last column."""
    encode_wkt(df, "wkt", x, y).write.mode("overwrite").option("sep", "|").csv(path)


def write_result_csv(df: DataFrame, path: str, decimals: int | None = None,
                     single_file: bool = False, ordered: bool = False) -> None:
    """``origin,destination,distance`` with header; joined destinations get quoted.

    ``ordered`` sorts by origin, distance and destination over all files: the
    files are ranges of origins, their numbers follow the order, and so do the
    rows in each.

    ``decimals=6`` writes fixed-point distances, ``None`` the shortest form that
    reads back equal.  ``single_file`` sends the result through one task; use it
    for small results only.
    """
    out = df.select("origin", "destination", "distance")
    if decimals is not None and ordered:
        raise ValueError("fixed-point text has another order than the numbers")
    if decimals is not None:
        out = out.withColumn("distance", F.format_string(f"%.{decimals}f", "distance"))
    by = [F.asc_nulls_last(c) for c in ("origin", "distance", "destination")]
    if single_file:
        out = out.coalesce(1)
    if ordered:
        out = (out if single_file else out.repartitionByRange(*by)).sortWithinPartitions(*by)
    out.write.mode("overwrite").option("header", True).csv(path)


def read_result_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT_SCHEMA).option("header", True).csv(path)


def read_ordered_csv(spark: SparkSession, path: str) -> DataFrame:
    """A result written with ``ordered=True``, with each row's ``position`` in it, from 1.

    Rows are numbered inside each split of a file; the numbers of rows in the
    splits before, one per split, do the rest.
    """
    read = read_result_csv(spark, path).select(
        "*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__id"))
    split = ["__file", "__block"]
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    starts = read.groupBy(*split).agg(F.count("*").alias("n")).select(
        *split, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*split).orderBy("__id"))
    return read.withColumn("__nth", inside).join(starts, split).select(
        (F.col("__before") + F.col("__nth")).alias("position"), *RESULT_SCHEMA.names)


# --- ORC -------------------------------------------------------------------


def read_points_orc(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """ORC with the schema of its files; ``glob`` (like ``*.orc``) picks files."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.orc(path)


def curve_code(x: Column, y: Column, cell: float = 1.0) -> Column:
    """Morton code of the grid cell of side ``cell`` holding a point: nearby points have nearby codes."""
    code = F.lit(0).cast("long")
    for shift, v in ((1, x), (0, y)):
        # 31 bits an axis, counted from far below zero; what lies beyond counts as the last cell.
        far = float(1 << 30)
        v = F.floor(F.greatest(F.lit(-far), F.least(v / F.lit(float(cell)), F.lit(far - 1)))).cast("long") + (1 << 30)
        for s, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, s)).bitwiseAND(F.lit(mask))
        code = code.bitwiseOR(F.shiftleft(v, shift))
    return code


def write_points_orc(df: DataFrame, path: str, x: str = "x", y: str = "y", clustered: bool = False,
                     cell: float = 1.0) -> None:
    """ORC with the point as WKB in ``geom_wkb``; replaces what is there.

    ``clustered`` writes the points along a space-filling curve over cells of
    side ``cell``: a file, and a row group in it, then covers a small area, so
    its minima and maxima let a reader skip it for a box on ``x`` and ``y``.
    """
    out = encode_wkb(df, "geom_wkb", x, y)
    if clustered:
        out = out.withColumn("__curve", curve_code(F.col(x), F.col(y), cell))
        out = out.repartitionByRange("__curve").sortWithinPartitions("__curve").drop("__curve")
    out.write.mode("overwrite").orc(path)


# --- tables ----------------------------------------------------------------


def read_points_jdbc(spark: SparkSession, url: str, table: str,
                     predicates: list[str] | None = None, **properties: str) -> DataFrame:
    """A database table over JDBC, read by one task per predicate.

    Column selections and filters on the result are pushed into the database.
    """
    if predicates:
        return spark.read.jdbc(url, table, predicates=predicates, properties=properties)
    return spark.read.jdbc(url, table, properties=properties)


def by_name(df: DataFrame, target: T.StructType) -> DataFrame:
    """``df`` in the columns, order and types of ``target``, matched ignoring case.

    Columns the target lacks are dropped; those missing here become NULL.
    """
    have = {c.lower(): c for c in df.columns}
    cols = []
    for field in target.fields:
        source = have.get(field.name.lower())
        value = F.col(f"`{source}`") if source else F.lit(None)
        cols.append(value.cast(field.dataType).alias(field.name))
    return df.select(*cols)


def append_by_name(df: DataFrame, table: DataFrame) -> DataFrame:
    """``table`` plus the rows of ``df``, matched by column name ignoring case."""
    return table.unionByName(by_name(df, table.schema))


def save_result_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Create or replace the catalog table ``name`` from a query.

    With ``path`` its files live there instead of in the warehouse folder.
    """
    writer = df.write.mode("overwrite")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def new_keys(existing: DataFrame, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of ``batch`` to insert: the first per key (in ``order``), unknown keys only.

    The key is a primary key: a NULL in it is an error, raised when the rows are read.
    """
    known = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"{key} is NULL"))).otherwise(F.col(key))
    batch = batch.withColumn(key, known.cast(batch.schema[key].dataType))
    first = Window.partitionBy(key).orderBy(*order)
    once = batch.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")
    return once.join(existing.select(key), key, "left_anti")


def insert_new_keys(spark: SparkSession, path: str, batch: DataFrame, key: str,
                    order: list[str]) -> None:
    """Append ``batch`` to the ORC table at ``path``; existing keys win."""
    existing = spark.read.orc(path)
    rows = by_name(new_keys(existing, batch, key, order), existing.schema)
    rows.write.mode("append").orc(path)


def create_keyed_table(spark: SparkSession, name: str, schema: T.StructType, key: str, buckets: int,
                       path: str | None = None) -> None:
    """An empty catalog table in ORC, bucketed and sorted by its key; an existing one stays.

    Choose as many buckets as the largest load needs tasks: a bucket is the
    smallest part that meets new keys.
    """
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    place = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING orc CLUSTERED BY (`{key}`) "
              f"SORTED BY (`{key}`) INTO {buckets} BUCKETS{place}")


def keys_to_insert(spark: SparkSession, name: str, batch: DataFrame, key: str, order: list[str], buckets: int) -> DataFrame:
    """The rows of :func:`new_keys` for a keyed table, one partition per bucket.

    The batch is shuffled into the table's buckets; the table itself is read
    bucket by bucket and not shuffled, however large it is.
    """
    target = spark.table(name)
    typed = by_name(batch, target.schema) if set(order) <= set(target.columns) else batch
    typed = typed.withColumn(key, F.col(key).cast(target.schema[key].dataType)).repartition(buckets, key)
    return by_name(new_keys(target.hint("shuffle_merge"), typed, key, order), target.schema)


def insert_into_keyed_table(spark: SparkSession, name: str, batch: DataFrame, key: str, order: list[str], buckets: int) -> None:
    """Append ``batch`` to a table of :func:`create_keyed_table`; existing keys win."""
    rows = keys_to_insert(spark, name, batch, key, order, buckets)
    rows.write.format("orc").bucketBy(buckets, key).sortBy(key).mode("append").saveAsTable(name)
