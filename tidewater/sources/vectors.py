"""Vector files: GeoJSON, WKB columns as GeoParquet has them, and shapefiles in zip archives, read into the rings of operators.geometry.

Outer rings run against the clock and holes with it, whatever the file says. GeoJSON is parsed by Spark; a collection is one document,
so large tables are written and read as one feature a line. Sinks give the same three forms of text or bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.geometry import RINGS, oriented

#: Fixed by the format: geometry types of well-known binary and of shapefiles.
WKB_POINT, WKB_POLYGON, WKB_MULTIPOLYGON = 1, 3, 6
SHAPE_POLYGON = 5


def closed_rings(coordinates: Column) -> Column:
    """Parts of rings of corners, from nested coordinates whose rings end with their first corner."""
    corner = lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))
    return F.transform(coordinates, lambda part: F.transform(part, lambda ring: F.transform(F.slice(ring, 1, F.size(ring) - 1), corner)))


def geojson(spark: SparkSession, path: str, properties: str, lines: bool = False) -> DataFrame:
    """Properties (a DDL) of each feature, its rings (null unless it is a polygon or several), and x and y of points.

    lines: a feature a line; else a file is a FeatureCollection.
    """
    feature = f"struct<properties: struct<{StructType.fromDDL(properties).simpleString()[7:-1]}>, geometry: struct<type: string, coordinates: string>>"
    if lines:
        rows = spark.read.text(path).where(F.length("value") > 0).select(F.from_json("value", feature).alias("f"))
    else:
        rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"struct<features: array<{feature}>>")["features"]).alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    ring = "array<array<array<double>>>"
    parts = F.when(kind == "Polygon", F.array(F.from_json(text, ring))).when(kind == "MultiPolygon", F.from_json(text, f"array<{ring}>"))
    point = F.when(kind == "Point", F.from_json(text, "array<double>"))
    return rows.select("f.properties.*", oriented(closed_rings(parts)).alias("rings"), point[0].alias("x"), point[1].alias("y"))


def to_geojson(df: DataFrame, parts: str) -> DataFrame:
    """A GeoJSON feature a row, as value: all other columns are its properties. parts: arrays of rings, the outer one first."""
    closed = lambda ring: F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda c: F.array(c["x"], c["y"]))
    coordinates = F.transform(parts, lambda part: F.transform(part, closed))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates"))
    properties = F.struct(*(c for c in df.columns if c != parts))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("value"))


def mapped(df: DataFrame, source: str, target: str, ddl: str, convert: Callable) -> DataFrame:
    """df with the column source replaced by target, a converted value of each row; others pass as Arrow."""
    keep = [c for c in df.columns if c != source]
    schema = StructType([*df.select(*keep).schema.fields, *StructType.fromDDL(f"`{target}` {ddl}").fields])
    kind = to_arrow_schema(schema).field(len(keep)).type

    def run(batches):
        for b in batches:
            made = pa.array([None if v is None else convert(v) for v in b.column(len(keep)).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), made], names=[*keep, target])

    return df.select(*keep, source).mapInArrow(run, schema)


def parts_of_wkb(data: bytes) -> list | None:
    """Parts of a polygon or of several; None for other kinds. Heights and measures are read over."""

    def read(at: int) -> tuple[list, int]:
        order = "<" if data[at] else ">"
        kind = struct.unpack_from(f"{order}I", data, at + 1)[0]
        at += 5 + 4 * bool(kind & 0x20000000)  # a reference system's number
        flat, more = kind & 0xFFFFFF, bin(kind >> 30).count("1")
        flat, more = flat % 1000, more + (0, 1, 1, 2)[flat // 1000]
        count, at = struct.unpack_from(f"{order}I", data, at)[0], at + 4
        if flat == WKB_MULTIPOLYGON:
            parts = []
            for _ in range(count):
                own, at = read(at)
                parts += own
            return parts, at
        if flat != WKB_POLYGON:
            return [], len(data)
        rings, width = [], 2 + more
        for _ in range(count):
            n, at = struct.unpack_from(f"{order}I", data, at)[0], at + 4
            flat_corners = struct.unpack_from(f"{order}{n * width}d", data, at)
            at += 8 * n * width
            rings.append([{"x": flat_corners[k], "y": flat_corners[k + 1]} for k in range(0, (n - 1) * width, width)])
        return [rings], at

    return read(0)[0] or None


def wkb_of_parts(parts: list) -> bytes:
    def ring(corners: list) -> bytes:
        every = [*corners, corners[0]]
        return struct.pack(f"<I{2 * len(every)}d", len(every), *(v for c in every for v in (c["x"], c["y"])))

    polygon = lambda rings: struct.pack("<BII", 1, WKB_POLYGON, len(rings)) + b"".join(map(ring, rings))
    return struct.pack("<BII", 1, WKB_MULTIPOLYGON, len(parts)) + b"".join(map(polygon, parts))


def from_wkb(df: DataFrame, source: str, target: str = "rings") -> DataFrame:
    """A column of well-known binary as oriented rings; null for null and for what is no polygon."""
    parts = mapped(df, source, "_parts", f"array<{RINGS}>", parts_of_wkb)
    return parts.withColumn(target, oriented(F.col("_parts"))).drop("_parts")


def to_wkb(df: DataFrame, parts: str, target: str = "geometry") -> DataFrame:
    return mapped(df, parts, target, "binary", wkb_of_parts)


def geoparquet(spark: SparkSession, path: str, geometry: str = "geometry") -> DataFrame:
    """A GeoParquet table with rings in place of its geometry; a select of other columns reads no geometry."""
    return from_wkb(spark.read.parquet(path), geometry)


def shapes(data: bytes) -> list[list | None]:
    """Rings of each polygon record of a .shp file, turned against the clock if outer; None for null shapes."""
    out, at = [], 100
    while at + 8 <= len(data):
        size = struct.unpack_from(">i", data, at + 4)[0] * 2
        body, at = data[at + 8 : at + 8 + size], at + 8 + size
        if struct.unpack_from("<i", body)[0] % 10 != SHAPE_POLYGON:
            out.append(None)
            continue
        n_rings, n = struct.unpack_from("<ii", body, 36)
        starts = [*struct.unpack_from(f"<{n_rings}i", body, 44), n]
        flat = struct.unpack_from(f"<{2 * n}d", body, 44 + 4 * n_rings)
        out.append([[{"x": flat[2 * k], "y": flat[2 * k + 1]} for k in range(b - 1, a, -1)] for a, b in zip(starts[:-1], starts[1:], strict=True)])
    return out


def attributes(data: bytes) -> list[dict[str, str]]:
    """The records of a .dbf file as texts."""
    n, start, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 1
    for k in range(32, start - 1, 32):
        width = data[k + 16]
        fields.append((data[k : k + 11].split(b"\0")[0].decode("latin-1"), at, width))
        at += width
    rows = (data[start + k * size : start + (k + 1) * size] for k in range(n))
    return [{name: row[a : a + w].decode("utf-8", "replace").strip() for name, a, w in fields} for row in rows]


def zipped_shapefiles(archives: DataFrame) -> DataFrame:
    """layer, properties (a map of texts) and rings of every record of the shapefiles in zip archives, given as a binary column content."""

    def run(batches):
        import io
        import zipfile

        kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        for b in batches:
            for content in b.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in sorted(n for n in z.namelist() if n.lower().endswith(".shp")):
                        rings, rows = shapes(z.read(name)), attributes(z.read(name[:-3] + ("dbf" if name[-1] == "p" else "DBF")))
                        for k in range(0, len(rings), 1024):
                            some = rings[k : k + 1024]
                            columns = [pa.array([name[:-4]] * len(some)), pa.array([list(r.items()) for r in rows[k : k + 1024]], pa.map_(pa.string(), pa.string())), pa.array(some, kind)]
                            yield pa.RecordBatch.from_arrays(columns, names=["layer", "properties", "rings"])

    return archives.select("content").mapInArrow(run, f"layer string, properties map<string, string>, rings {RINGS}")
