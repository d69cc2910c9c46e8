"""Scans: typed and all-string delimited text, whitespace tables, Parquet with evolving schemas, JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Event times come without zone and mean UTC."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def typed_csv(spark: SparkSession, path: str, ddl: str, **options) -> DataFrame:
    """Delimited text under a declared schema; codes keep their leading zeros."""
    return spark.read.schema(ddl).options(header=True, **options).csv(path)


def text_csv(spark: SparkSession, path: str, columns: list[str], **options) -> DataFrame:
    """Delimited text with every column a string."""
    return typed_csv(spark, path, ", ".join(f"`{c}` string" for c in columns), **options)


def zip_csv(archives: DataFrame, member: str, ddl: str) -> DataFrame:
    """Delimited text with header lines in the members, named as the pattern says, of zip archives given as a binary column content.

    As spark.read.format("binaryFile") gives them: then the archives may be in any store. A member is read line by line.
    """
    import io
    import re
    import zipfile

    import pyarrow as pa

    def lines(batches):
        for b in batches:
            for content in b.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in sorted(z.namelist()):
                        if re.fullmatch(member, name):
                            with io.TextIOWrapper(z.open(name), encoding="utf-8", newline="") as f:
                                next(f, None)
                                while some := [x.rstrip("\r\n") for _, x in zip(range(4096), f)]:
                                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["line"])

    rows = archives.select("content").mapInArrow(lines, "line string")
    return rows.select(F.from_csv("line", ddl).alias("row")).select("row.*")


def zipped(lines: DataFrame, archive: str, member: str, line: str, header: str) -> DataFrame:
    """A zip archive a row, as content: members of lines under a header. An archive is made by one task, so it is as small as its reader needs it."""
    import io
    import zipfile

    import pandas as pd

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, own in rows.groupby(member):
                z.writestr(name, "\n".join([header, *own[line]]) + "\n")
        return pd.DataFrame({archive: [rows[archive].iloc[0]], "content": [out.getvalue()]})

    return lines.groupBy(archive).applyInPandas(pack, f"{archive} string, content binary")


def prefiltered_tsv(spark: SparkSession, path: str, columns: list[str], needles: list[str], exact: Column) -> DataFrame:
    """Headerless tab-separated rows: a cheap substring test on the raw line, then the exact one on columns."""
    lines = spark.read.text(path)
    cheap = None
    for n in needles:
        cheap = F.contains("value", F.lit(n)) if cheap is None else cheap | F.contains("value", F.lit(n))
    parts = F.split("value", "\t")
    return lines.where(cheap).select(*(parts[k].alias(c) for k, c in enumerate(columns))).where(exact)


def wide_text_to_long(spark: SparkSession, path: str, missing: float) -> DataFrame:
    """Whitespace tables of a year and twelve months, as year, month and value; the sentinel becomes null."""
    words = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(words.alias("w")).where(F.size("w") >= 13)
    long = rows.select(F.col("w")[0].try_cast("int").alias("year"), F.posexplode(F.slice("w", 2, 12)).alias("month", "value"))
    return long.where(F.col("year").isNotNull()).select(
        "year", (F.col("month") + 1).alias("month"), F.nullif(F.col("value").try_cast("double"), F.lit(missing)).alias("value")
    )


def evolving(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a part lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities of all floating columns as null: the one kind of missing value inside the engine."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.select(*(F.when(~bad(F.col(c)), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
