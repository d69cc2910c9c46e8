"""Sharding by fixed virtual slots.

Every record is hashed into one of `slots` virtual slots (thousands, fixed for the life of a
corpus). Rows that are equal in key, size and text's crc32 are told apart by a salt, their number in the scan,
or all of them would fill one slot; the records are written once with it, so that a row keeps its slot in all
that follows and when tasks run again. A slot's bytes are summed, and a versioned table maps slots to shards. Rebalancing edits
that table only: slots that overfill a shard move to the lightest shards, all others stay.

Everything runs as DataFrame functions. The only data that grows with the corpus are the scans;
the map has exactly `slots` rows, so its broadcast and its single-task fold are bounded.

Edge cases: a null or empty text has 8 bytes of size; null keys hash like any other value;
repeated rows spread over slots by salt, so which of them gets which place
depends on the scan, but nothing that tells them apart does; a very long text counts with all of its bytes, and one
over a shard's fair share has a shard of its own; ties of the rank in a slot are only between equal rows; an empty table gives no rows; columns
of the input other than the key and text are ignored, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, dropped, shared_dir, written

SLOTS = 4096
ROW_OVERHEAD = 8


def records(docs: DataFrame, slots: int = SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32 and virtual_slot of every row, written."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(t) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
    )
    own = ["doc_id", "size", "text_crc32"]
    named = out.withColumn("code", F.xxhash64(*own))
    often = written(named.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("code", F.lit(True).alias("again")), "repeated")
    salted = named.withColumn("salt", F.monotonically_increasing_id()).join(broadcast_if_small(often, F.lit(16)), "code", "left")
    slot = F.pmod(F.when(F.col("again"), F.xxhash64("code", "salt")).otherwise(F.col("code")), F.lit(slots)).cast("int")
    recs = written(salted.select(*own, slot.alias("virtual_slot")), "records")
    dropped(often)
    return recs


def slot_loads(recs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every slot, empty slots included."""
    sums = recs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = recs.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows")
    )


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: equal runs of slots."""
    slot = F.col("id").cast("int")
    return spark.range(slots).select(
        F.lit(0).alias("version"), slot.alias("virtual_slot"), F.floor(F.col("id") * shards / slots).cast("int").alias("shard")
    )


def rebalance(slot_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The map's next version: slots beyond a shard's fair share move to the lightest shard, largest first."""
    in_shard = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        slot_map.join(loads, "virtual_slot")
        .withColumn("mean", F.sum("bytes").over(Window.partitionBy()) / shards)
        .withColumn("giant", F.col("bytes") > F.col("mean"))  # fills a shard of its own; the others share the rest
        .withColumn("fair", F.sum(F.when(~F.col("giant"), F.col("bytes"))).over(Window.partitionBy()) / F.greatest(F.lit(1), shards - F.count_if("giant").over(Window.partitionBy())))
        .withColumn("stays", (F.col("shard") < shards) & ~F.col("giant") & (F.sum("bytes").over(in_shard) <= F.col("fair")))
    )
    folded = placed.agg(
        F.max("version").alias("version"),
        F.collect_list(F.when(F.col("stays"), F.struct("virtual_slot", "shard", "bytes"))).alias("kept"),
        F.sort_array(F.collect_list(F.when(~F.col("stays"), F.struct("bytes", (-F.col("virtual_slot")).alias("low")))), asc=False).alias("moved"),
    ).selectExpr(
        "version + 1 AS version",
        "kept",
        f"""aggregate(moved,
              named_struct('loads', transform(sequence(0, {shards - 1}), s -> aggregate(filter(kept, k -> k.shard = s), 0L, (a, k) -> a + k.bytes)),
                           'to', cast(array() AS array<struct<virtual_slot:int,shard:int>>)),
              (acc, m) -> named_struct(
                'loads', transform(acc.loads, (l, i) -> if(i = array_position(acc.loads, array_min(acc.loads)) - 1, l + m.bytes, l)),
                'to', concat(acc.to, array(named_struct('virtual_slot', -m.low, 'shard', cast(array_position(acc.loads, array_min(acc.loads)) - 1 AS int))))
              )).to AS moved""",
    )
    both = F.concat(F.transform("kept", lambda k: F.struct(k["virtual_slot"].alias("virtual_slot"), k["shard"].alias("shard"))), F.col("moved"))
    return folded.select("version", F.inline(both))


def store_map(slot_map: DataFrame, path: str) -> None:
    """Adds the map's version to the table at path; other versions stay."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, by default the newest."""
    every = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    if version is None:
        return every.where(F.col("version") == every.select(F.max("version")).scalar())
    return every.where(F.col("version") == version)


def place(recs: DataFrame, slot_map: DataFrame, loads: DataFrame) -> DataFrame:
    """Each record's shard, and its position in the shard (gapless from 0): rank in its slot plus the slots before."""
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    plan = slot_map.join(loads, "virtual_slot").select(
        "virtual_slot", "shard", F.col("version").alias("map_version"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")
    )
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32"))
    return recs.withColumn("rank", rank).join(F.broadcast(plan), "virtual_slot").withColumn("slot", F.col("offset") + F.col("rank") - 1)


def shard_documents(docs: DataFrame, shards: int = 24, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Places all rows by a freshly rebalanced map, stored at map_path (default: the shared folder)."""
    spark = docs.sparkSession
    recs = records(docs, slots)
    loads = slot_loads(recs, slots)
    path = map_path or f"{shared_dir(spark)}/tidewater/slot-map-{spark.sql('SELECT uuid()').first()[0]}"
    loads.write.parquet(f"{path}/loads")
    loads = spark.read.schema(loads.schema).parquet(f"{path}/loads")
    store_map(first_map(spark, shards, slots), f"{path}/map")
    store_map(rebalance(load_map(spark, f"{path}/map", 0), loads, shards), f"{path}/map")
    placed = place(recs, load_map(spark, f"{path}/map"), loads)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "map_version",
    )
