"""Sinks: compressed Parquet, partition overwrite, append, and replacement of exactly the incoming keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import nan_to_null


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", by: list[str] | None = None) -> None:
    """zstd Parquet. With `by`, only the partitions present in df are replaced on overwrite."""
    writer = df.write.mode(mode).option("compression", "zstd")
    if by:
        writer = writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def replace_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old whose keys are not in new, and all of new: running it twice changes nothing."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON object a row, missing numbers as null, never as NaN."""
    clean = nan_to_null(df)
    return clean.select(F.to_json(F.struct(*clean.columns), {"ignoreNullFields": "false"}).alias(name))
