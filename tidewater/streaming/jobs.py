"""Structured Streaming jobs: windows with watermarks, de-duplication, state, and idempotent upserts.

Every function takes a streaming (or batch) frame and gives one; the caller picks source, sink and trigger.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import delete, dropped, exists, written

LATE = "3 days"


def event_files(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet files; event times without zone are read as UTC."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def watermarked(events: DataFrame, late: str | None) -> DataFrame:
    """late None: no watermark, so no row is ever too late and no state goes; for replays of all events into complete results."""
    return events if late is None else events.withWatermark("ts", late)


def tumbling(events: DataFrame, size: str, late: str | None = LATE) -> DataFrame:
    w = F.window("ts", size)
    return watermarked(events, late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sliding(events: DataFrame, size: str, step: str, late: str | None = LATE) -> DataFrame:
    w = F.window("ts", size, step)
    return watermarked(events, late).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "n", "value")


def sessions(events: DataFrame, gap: str, late: str | None = LATE) -> DataFrame:
    w = F.session_window("ts", gap)
    return watermarked(events, late).groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, keys: list[str], late: str | None = LATE) -> DataFrame:
    """Repeats of a key within the watermark go; without one, all repeats."""
    return events.dropDuplicates(keys) if late is None else events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def with_reference(events: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """The same static table joined to every batch."""
    return events.join(reference, key, "left")


def seam(archive: DataFrame, live: DataFrame, until: str) -> DataFrame:
    """Archive rows before a time and live ones from then on, named by product."""
    cut = F.to_timestamp(F.lit(until))
    a = archive.where(F.col("ts") < cut).withColumn("product", F.lit("archive"))
    return a.unionByName(live.where(F.col("ts") >= cut).withColumn("product", F.lit("live")))


def counters(events: DataFrame) -> DataFrame:
    """Running counts and totals of each event type, kept in state of a few numbers a key."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"event_type": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("event_type").applyInPandasWithState(step, "event_type string, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def by_day(path: str, df: DataFrame) -> None:
    """Replaces the days that df has, whole."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("day").parquet(path)


def stored(like: DataFrame, path: str) -> DataFrame:
    """The table at path with the columns of like; without rows where there is none yet."""
    spark = like.sparkSession
    return spark.read.schema(like.schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], like.schema)


def upsert_days(batch: DataFrame, path: str, keys: list[str]) -> None:
    """foreachBatch sink: rows replace those of equal keys on the days of the batch, and all others stay.

    So a day over several batches keeps all of them, a day that is fetched again comes once, and a batch that runs twice, or a
    replay in other batches, changes nothing. Only the batch's days are read and written. Of equal keys in a batch one row is kept,
    the greatest.
    """
    rows = batch.withColumn("day", F.to_date("ts"))
    rows = rows.groupBy("day", *keys).agg(F.max(F.struct(*(c for c in rows.columns if c not in ("day", *keys)))).alias("_rest")).select("day", *keys, "_rest.*").select(*rows.columns)
    held = written(rows, "batch")
    days = [r.day for r in held.select("day").distinct().collect()]  # of one batch
    touched = F.col("day").isin([d for d in days if d is not None])
    old = stored(held, path).where(touched | F.col("day").isNull() if None in days else touched)
    same = [old[c].eqNullSafe(held[c]) for c in ("day", *keys)]
    old = old.join(held.select("day", *keys), reduce(and_, same), "left_anti")
    by_day(path, held.unionByName(old))
    dropped(held)


LEDGER = "batch long, high timestamp, n long, n_late long"


def keep_late(batch: DataFrame, number: int, path: str, size: str, keys: list[str], late: str = LATE) -> None:
    """foreachBatch sink: rows of windows that ended more than `late` before the newest row of earlier batches are set apart and counted; the others are upserted.

    The ledger has a row for each batch: its newest time, its rows, and how many came too late. A batch that runs twice finds the
    bound that it had at first, as only the batches before it count. Rows without a time are dropped, as by any window.
    """
    spark = batch.sparkSession
    known = spark.read.schema(LEDGER).parquet(f"{path}/ledger") if exists(spark, f"{path}/ledger") else spark.createDataFrame([], LEDGER)
    high = known.where(F.col("batch") < number).select(F.max("high")).first()[0]
    rows = batch.withColumn("window", F.window("ts", size))
    bound = F.lit(high).cast("timestamp") - F.expr(f"INTERVAL {late}")
    rows = written(rows.withColumn("too_late", F.coalesce(F.col("window.end") <= bound, F.lit(False))).withColumn("window_start", F.col("window.start")).drop("window"), "batch")
    own = rows.agg(F.lit(number).cast("long").alias("batch"), F.max("ts").alias("high"), F.count(F.lit(1)).alias("n"), F.count_if("too_late").alias("n_late"))
    replace = lambda df, to: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{to}")
    replace(rows.where("too_late").drop("too_late").withColumn("batch", F.lit(number).cast("long")), "late")
    upsert_days(rows.where("NOT too_late").drop("too_late", "window_start"), f"{path}/days", keys)
    replace(own, "ledger")
    dropped(rows)


def late_windows(spark: SparkSession, path: str) -> DataFrame:
    """window_start and n of the windows that rows came too late for, since they were last corrected."""
    return spark.read.schema("window_start timestamp, batch long").parquet(f"{path}/late").groupBy("window_start").agg(F.count(F.lit(1)).alias("n"))


def refetch(source: DataFrame, path: str, size: str, keys: list[str]) -> None:
    """Takes the windows that rows came too late for from the source again, whole, and no others; then none is open any more."""
    spark = source.sparkSession
    if not exists(spark, f"{path}/late"):
        return
    open_ = written(late_windows(spark, path), "windows")
    rows = source.withColumn("window_start", F.window("ts", size)["start"]).join(open_.select("window_start"), "window_start", "left_semi").drop("window_start")
    upsert_days(rows, f"{path}/days", keys)
    delete(spark, f"{path}/late")
    dropped(open_)
