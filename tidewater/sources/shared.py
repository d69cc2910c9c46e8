"""Written tables in the folder that spark.checkpoint.dir names: they cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. A temporary folder only where the session names none and all tasks run in this process, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local($|\[)", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tidewater-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def store_of(spark: SparkSession, path: str):
    """The path in its store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def exists(spark: SparkSession, path: str) -> bool:
    store, p = store_of(spark, path)
    return store.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    store, p = store_of(spark, path)
    store.delete(p, True)


def written(df: DataFrame, what: str = "rounds") -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewater/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame, what: str = "") -> None:
    """Deletes the written tables that df reads, all of them or those named what. For tables that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if re.search(rf"/tidewater/{re.escape(what)}[^/]*-[0-9a-f]{{32}}(/\d+)?$", folder):
            delete(spark, folder)
