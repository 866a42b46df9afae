"""Batch jobs: preparing the point files, and loading them into a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geonear.functions.codec import decode_wkb, encode_wkt
from geonear.operators.grouping import group_colocated
from geonear.operators.polygons import cut_polygons, points_in_polygons
from geonear.sources.files import insert_new_keys, read_points_orc, write_points_orc

# Names of the raw property file and of the serving table.
SERVING_NAMES = {
    "UPRN": "uprn",
    "X_COORDINATE": "easting",
    "Y_COORDINATE": "northing",
    "LATITUDE": "lat",
    "LONGITUDE": "lon",
}


def prepare(points: DataFrame, postcodes: DataFrame, districts: DataFrame, district: str,
            out: str, x: str = "X_COORDINATE", y: str = "Y_COORDINATE") -> tuple[str, str]:
    """Write the origins and destinations of one district as two ORC tables.

    ``points`` are raw property rows, ``postcodes`` is ``(postcode, x, y)`` and
    ``districts`` ``(name, x1, y1, x2, y2)``.  Postcodes at one coordinate
    become one destination.  Returns the two paths.
    """
    origins_path, destinations_path = f"{out}/origins.orc", f"{out}/destinations.orc"
    located = points.withColumns({"x": F.col(x), "y": F.col(y)})
    chosen = cut_polygons(districts.where(F.col("name") == district))
    write_points_orc(points_in_polygons(located, chosen).drop("name"), origins_path)
    there = points_in_polygons(postcodes, chosen)
    grouped = group_colocated(there.select("postcode", "x", "y"), "postcode")
    write_points_orc(grouped, destinations_path)
    return origins_path, destinations_path


def load_serving_table(spark: SparkSession, orc: str, table: str, key: str,
                       schema: T.StructType, order: list[str] | None = None,
                       renames: dict[str, str] = SERVING_NAMES) -> DataFrame:
    """Load prepared ORC into the keyed ORC table at path ``table``.

    Raw names become serving names, the point and its WKT come from the stored
    WKB, and rows whose key is already there are left out.  An absent table is
    created with ``schema`` first.
    """
    _create_if_absent(spark, table, schema)
    raw = read_points_orc(spark, orc).withColumnsRenamed(renames)
    points = decode_wkb(raw, "geom_wkb", "x", "y")
    points = encode_wkt(points, "wkt").withColumn("geom", F.struct("x", "y"))
    insert_new_keys(spark, table, points, key, order or [key, "x", "y"])
    return spark.read.schema(schema).orc(table)


def _create_if_absent(spark: SparkSession, table: str, schema: T.StructType) -> None:
    spark.createDataFrame([], schema).write.mode("ignore").orc(table)


PROPERTY_SCHEMA = T.StructType(
    [
        T.StructField("uprn", T.LongType()),
        T.StructField("easting", T.DoubleType()),
        T.StructField("northing", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("geom", T.StructType([T.StructField("x", T.DoubleType()),
                                            T.StructField("y", T.DoubleType())])),
        T.StructField("wkt", T.StringType()),
    ]
)
POSTCODE_SCHEMA = T.StructType([T.StructField("postcode", T.StringType()),
                                *PROPERTY_SCHEMA.fields[5:]])
