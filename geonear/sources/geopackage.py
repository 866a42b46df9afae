"""GeoPackage layers as a Spark data source.

A GeoPackage is one SQLite file, read here with Python's own module in the
tasks that scan it, one range of row ids each.  The files must be on storage
that every executor sees under the same path.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _source_class():
    # Defined in here so that workers get the class by value.
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Rows(InputPartition):
        def __init__(self, path, first, last):
            self.path, self.first, self.last = path, first, last

    def layer_columns(path, table):
        import sqlite3

        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            geometry = db.execute(
                "select column_name from gpkg_geometry_columns where table_name = ?", (table,)
            ).fetchone()
            if geometry is None:
                raise ValueError(f"{path} has no feature layer {table!r}")
            columns = db.execute(f'pragma table_info("{table}")').fetchall()
        key = next((c[1] for c in columns if c[5]), "rowid")
        plain = [(c[1], c[2].upper()) for c in columns if c[1] not in (geometry[0], key)]
        return key, geometry[0], plain

    def file_list(path):
        import glob
        import os

        path = path.removeprefix("file:")
        if os.path.isdir(path):
            path = os.path.join(path, "*.gpkg")
        found = sorted(glob.glob(path))
        if not found:
            raise FileNotFoundError(f"no GeoPackage at {path}")
        return found

    class GeoPackageReader(DataSourceReader):
        def __init__(self, schema, options):
            import json

            self.schema = schema
            self.table = options["tableName"]
            self.files = file_list(options["path"])
            self.rows = int(options.get("rowsPerPartition", 500_000))
            box = options.get("box")
            self.box = [float(v) for v in box.split(",")] if box else None
            self.where, self.values = "", []
            for column, test, value in json.loads(options.get("where", "[]")):
                field = next((c for c in schema.fields[:-2] if c.name == column), None)
                if field is None or test not in ("=", "<>", "<", "<=", ">", ">=", "in"):
                    raise ValueError(f"no comparison {column} {test}")
                # As bytes, as Spark compares; the file may name another order for a column.
                name = '"' + column.replace('"', '""') + '"' + " collate binary" * (field.dataType.typeName() == "string")
                values = value if test == "in" else [value]
                marks = f"({', '.join('?' * len(values))})" if test == "in" else "?"
                self.where += f" and {name} {test} {marks}"
                self.values += values

        def partitions(self):
            import os
            import sqlite3

            parts = []
            for path in self.files:
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    low, high = db.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
                    if low is None:
                        continue
                    # Ids may leave gaps of any size, so their span says little: no more
                    # slices than the file has megabytes, and none without rows.
                    most = os.path.getsize(path) // (1 << 20) + 1
                    n = max(1, min(-(-(high - low + 1) // self.rows), max(most, 8)))
                    width = -(-(high - low + 1) // n)
                    for first in range(low, high + 1, width):
                        last = min(first + width - 1, high)
                        found = db.execute(
                            f'select rowid from "{self.table}" where rowid between ? and ? order by rowid limit 1',
                            (first, last)).fetchone()
                        if found:
                            parts.append(Rows(path, found[0], last))
            return parts or [Rows(None, 0, -1)]

        def read(self, partition):
            import sqlite3
            import struct

            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_schema

            if partition.path is None:
                return
            target = to_arrow_schema(self.schema)
            key, geometry, plain = layer_columns(partition.path, self.table)
            # By name: files of a layer may hold its columns in another order.
            wanted = [f.name for f in target][:-2]
            missing = set(wanted) - {key, *[p[0] for p in plain]}
            if missing:
                raise ValueError(f"{partition.path} lacks columns {sorted(missing)} of {self.table!r}")
            names = ", ".join(f'"{n}"' for n in (*wanted, geometry))
            # Bytes of the envelope by its code in the header's flags.
            envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
            with sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True) as db:
                where, values = self.where, list(self.values)
                index = f"rtree_{self.table}_{geometry}"
                known = db.execute("select 1 from sqlite_master where name = ?", (index,)).fetchone()
                if self.box and known:
                    where += (f' and rowid in (select id from "{index}" where maxx >= ? and maxy >= ? '
                              "and minx <= ? and miny <= ?)")
                    values += self.box
                cursor = db.execute(
                    f'select {names} from "{self.table}" where rowid between ? and ?{where}',
                    (partition.first, partition.last, *values),
                )
                while rows := cursor.fetchmany(20_000):
                    columns = [list(c) for c in zip(*rows)]
                    srids, bodies = [], []
                    for blob in columns.pop():
                        if blob is None:
                            srids.append(None)
                            bodies.append(None)
                            continue
                        flags = blob[3]
                        order = "<" if flags & 1 else ">"
                        srids.append(struct.unpack_from(order + "i", blob, 4)[0])
                        bodies.append(blob[8 + envelope[flags >> 1 & 7]:])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip([*columns, srids, bodies], target)],
                        schema=target,
                    )

    class GeoPackageSource(DataSource):
        @classmethod
        def name(cls):
            return "geopackage"

        def schema(self):
            key, _, plain = layer_columns(
                file_list(self.options["path"])[0], self.options["tableName"]
            )

            def spark_type(declared):
                # Column types of the GeoPackage standard.
                base = declared.split("(")[0].strip()
                if base in ("BOOLEAN",):
                    return "boolean"
                if base in ("TINYINT", "SMALLINT", "MEDIUMINT", "INT", "INTEGER"):
                    return "bigint"
                if base in ("FLOAT", "DOUBLE", "REAL"):
                    return "double"
                return "binary" if base == "BLOB" else "string"

            attributes = [f"`{n}` {spark_type(t)}" for n, t in plain]
            return ", ".join([f"`{key}` bigint", *attributes, "`srs_id` int", "`wkb` binary"])

        def reader(self, schema):
            return GeoPackageReader(schema, self.options)

    return GeoPackageSource


def register_geopackage(spark: SparkSession) -> None:
    """Make ``spark.read.format("geopackage").option("tableName", …)`` available."""
    spark.dataSource.register(_source_class())


def read_geopackage(spark: SparkSession, path: str, layer: str,
                    rows_per_partition: int = 500_000,
                    box: tuple[float, float, float, float] | None = None,
                    where: list[tuple] | None = None) -> DataFrame:
    """Row id, attributes, ``srs_id`` and ``wkb`` of a layer.

    ``path`` is a file, a folder of ``.gpkg`` files or a pattern. ``where`` lists
    comparisons ``(column, test, value)`` that all hold for the rows read, with a
    test of ``= <> < <= > >= in``; NULL meets none. They are answered inside the
    files, by their indexes where there are any. With ``box`` (least x, least y,
    greatest x, greatest y) rows whose geometry lies outside may be left out:
    files with an R-tree of the layer do so.

    Filters that Spark itself pushes into Python sources aren't taken: two
    different filters of one DataFrame then share the last one (Spark 4.1).
    """
    register_geopackage(spark)
    reader = spark.read.format("geopackage").option("tableName", layer)
    if where:
        reader = reader.option("where", json.dumps([list(w) for w in where]))
    if box:
        reader = reader.option("box", ",".join(repr(float(v)) for v in box))
    return reader.option("rowsPerPartition", rows_per_partition).load(path)


def _ring_udf():
    def rings(wkb):
        import struct

        import numpy as np
        import pyarrow as pa

        vertices, ring_sizes, ring_counts, known = [np.zeros((0, 2))], [], [], []

        def polygon(body, at):
            """Take in the rings of one WKB polygon; the position after it and their number."""
            order = "<" if body[at] else ">"
            (count,) = struct.unpack_from(order + "I", body, at + 5)
            at += 9
            for _ in range(count):
                (size,) = struct.unpack_from(order + "I", body, at)
                vertices.append(np.frombuffer(body, order + "f8", 2 * size, at + 4).reshape(-1, 2))
                ring_sizes.append(size)
                at += 4 + 16 * size
            return at, count

        for body in wkb.to_pylist():
            kind, held = 0, 0
            if body is not None:
                order = "<" if body[0] else ">"
                (kind,) = struct.unpack_from(order + "I", body, 1)
            if kind == 3:
                held = polygon(body, 0)[1]
            elif kind == 6:
                (parts,) = struct.unpack_from(order + "I", body, 5)
                at = 9
                for _ in range(parts):
                    at, more = polygon(body, at)
                    held += more
            known.append(kind in (3, 6))
            ring_counts.append(held)
        xy = np.concatenate(vertices).astype("f8")
        point = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=["x", "y"])
        ring = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *ring_sizes]).astype("i4")), point)
        # A missing start marks a NULL geometry, or one that is no polygon.
        starts = np.cumsum([0, *ring_counts]).astype("i4").tolist()
        offsets = [a if ok else None for a, ok in zip(starts, known)] + starts[-1:]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ring)

    return F.arrow_udf(rings, "array<array<struct<x: double, y: double>>>").asNondeterministic()


def polygon_edges(df: DataFrame, name: str = "name", wkb: str = "wkb") -> DataFrame:
    """Edges ``(name, x1, y1, x2, y2)`` of 2D polygon or multipolygon geometries."""
    rings = df.select(F.col(name).alias("name"), _ring_udf()(F.col(wkb)).alias("rings")).select(
        "name", F.explode("rings").alias("v")
    )
    sides = rings.selectExpr("name", "v", "inline(transform(v, (p, i) -> struct(p as a, i as i)))")
    sides = sides.selectExpr("name", "a", "v[(i + 1) % size(v)] as b")
    flat = sides.selectExpr("name", "a.x as x1", "a.y as y1", "b.x as x2", "b.y as y2")
    return flat.where("x1 <> x2 or y1 <> y2")
