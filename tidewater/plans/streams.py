"""Queries that run as streams over the events table, to the end and then read back; batch twins where SQL has them.

A replay ends with its files, and files may come in any order. So windows and sessions are read as complete results, as
append mode would keep those of the last days in state; and sessions and repeats, which drop rows behind the watermark in
every mode, go without one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from ..sources.tables import table
from ..streaming import jobs as J
from .registry import query


def shared(spark):
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


def events(spark, d):
    return J.event_files(spark, f"{d}/events*.parquet", table(spark, d, "events").schema)


def drained(stream, mode="append"):
    """Runs a stream over all files there are, into Parquet batch by batch, and reads the result: of all batches, or in complete mode of the last one, which has all."""
    spark, base = stream.sparkSession, shared(stream.sparkSession)

    def keep(batch, k):
        batch.withColumn("batch", F.lit(k)).write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    empty = spark.createDataFrame([], stream.schema.add("batch", "long"))
    empty.write.mode("append").parquet(f"{base}/out")
    return spark.read.schema(empty.schema).parquet(f"{base}/out")


def stamped(df, *columns):
    """Times as text in UTC, the same in every engine."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


TUMBLING = "SELECT strftime(date_trunc('{}', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"


@query("stream_ingest", "SELECT event_id, user_id, event_type, value, props, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events WHERE event_type = 'error'")
def stream_ingest(spark, d):
    return stamped(drained(events(spark, d).where("event_type = 'error'")).select("event_id", "user_id", "event_type", "value", "props", "ts"), "ts")


@query("stream_two_times", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, bool_and(now() >= ts) AS later FROM events GROUP BY 1")
def stream_two_times(spark, d):
    return drained(events(spark, d).withColumn("ingested", F.current_timestamp())).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("ingested") >= F.col("ts")).alias("later"))


@query("stream_tumbling", TUMBLING.format("day"))
def stream_tumbling(spark, d):
    return stamped(drained(J.tumbling(events(spark, d), "1 day"), "complete").drop("batch"), "start")


@query("stream_late_data", TUMBLING.format("hour"))
def stream_late_data(spark, d):
    """Events in files of which the newest come first: what is over three days late is set apart, then its hours are fetched again."""
    base, e = shared(spark), table(spark, d, "events")
    day = F.date_trunc("day", "ts")
    first, last = e.agg(F.min(day), F.max(day)).first()
    middle = first + (last - first) / 2
    for k, part in enumerate((F.col("ts") >= middle, F.col("ts") < middle)):
        e.where(part).write.mode("append").parquet(f"{base}/files/{k}")
        files = J.event_files(spark, f"{base}/files/*", e.schema)
        run = files.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(lambda b, n: J.keep_late(b, n, f"{base}/kept", "1 hour", ["event_id"])).start()
        run.awaitTermination()
    J.refetch(e.withColumn("ts", F.col("ts").cast("timestamp")), f"{base}/kept", "1 hour", ["event_id"])
    return stamped(J.tumbling(spark.read.parquet(f"{base}/kept/days"), "1 hour", late=None), "start")


@query("stream_sliding", "SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS value FROM (SELECT value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY 1")
def stream_sliding(spark, d):
    return stamped(drained(J.sliding(events(spark, d), "1 hour", "30 minutes"), "complete").drop("batch"), "start").withColumn("value", F.round("value", 4))


@query("stream_session", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM i GROUP BY user_id, i")
def stream_session(spark, d):
    return stamped(drained(J.sessions(events(spark, d), "30 minutes", late=None), "complete").select("user_id", "start", "n"), "start")


@query("stream_dedup", "SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark, d):
    e = events(spark, d)
    return drained(J.once(e.unionByName(events(spark, d)), ["event_id"], late=None)).select("event_id", "user_id", "event_type")


@query("stream_state_counters", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stream_state_counters(spark, d):
    out = drained(J.counters(events(spark, d)), "update")
    return out.groupBy("event_type").agg(F.max_by(F.struct("n", F.round("total", 2).alias("total")), "batch").alias("s")).select("event_type", "s.*")


@query("stream_static_join", "SELECT event_id, c_mktsegment AS segment FROM events LEFT JOIN customer ON c_custkey = user_id")
def stream_static_join(spark, d):
    reference = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return drained(J.with_reference(events(spark, d), reference, "user_id")).select("event_id", "segment")


@query("stream_seam_union", "SELECT CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'archive' ELSE 'live' END AS product, count(*) AS n FROM events GROUP BY 1")
def stream_seam_union(spark, d):
    e = events(spark, d)
    return drained(J.seam(e, events(spark, d), "2024-01-15 00:00:00")).groupBy("product").agg(F.count(F.lit(1)).alias("n"))


@query("stream_foreach_upsert", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def stream_foreach_upsert(spark, d):
    base = shared(spark)
    for again in range(2):  # the second run changes nothing
        run = events(spark, d).writeStream.option("checkpointLocation", f"{base}/state-{again}").trigger(availableNow=True).foreachBatch(lambda b, k: J.upsert_days(b, f"{base}/days", ["event_id"])).start()
        run.awaitTermination()
    return spark.read.parquet(f"{base}/days").groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("batch_tumbling", "SELECT CAST(date_trunc('day', ts) AS VARCHAR)[:10] AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def batch_tumbling(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return J.tumbling(e, "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n")


@query("batch_sliding", "SELECT CAST(s AS VARCHAR)[:19] AS start, count(*) AS n, round(sum(value), 4) AS value FROM (SELECT value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY 1")
def batch_sliding(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return J.sliding(e, "1 hour", "30 minutes").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("value", 4).alias("value"))


@query("batch_session", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT user_id, count(*) AS n FROM i GROUP BY user_id, i")
def batch_session(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return J.sessions(e, "30 minutes").select("user_id", "n")


@query("incremental_score", "WITH l AS (SELECT quantile_cont(value, 0.9) AS limit_ FROM events WHERE ts < TIMESTAMP '2024-01-21') SELECT event_id, value > limit_ AS flag FROM events, l WHERE CAST(ts AS DATE) = (SELECT CAST(max(ts) AS DATE) FROM events)")
def incremental_score(spark, d):
    """A threshold learned on the first three weeks scores only the newest day, whose rows alone are replaced."""
    e = table(spark, d, "events")
    limit = e.where("ts < TIMESTAMP_NTZ '2024-01-21'").agg(F.percentile("value", 0.9).alias("limit"))
    newest = e.where(F.to_date("ts") == e.select(F.to_date(F.max("ts"))).scalar())
    return newest.crossJoin(F.broadcast(limit)).select("event_id", (F.col("value") > F.col("limit")).alias("flag"))
