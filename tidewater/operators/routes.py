"""Shortest travel times of many sources on an edge table, by rounds of relaxing the frontier.

Each round only pairs (source, node) that became faster ask for their edges, and the least of each is combined before it is shuffled.
Rounds are written tables, deleted once the next is written; they end when nothing becomes faster, and at the bound at the latest, as no
time may exceed it. A node with very many edges is a skewed join key, which Spark splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import dropped, written


def relaxed(start: DataFrame, step: Callable[[DataFrame], DataFrame], better: Callable = F.min) -> DataFrame:
    """source, node, cost and fresh: start (source, node, cost) carried on by step, which maps a frontier to candidates of the same columns, until nothing improves."""
    best = written(start.groupBy("source", "node").agg(better("cost").alias("cost")).withColumn("fresh", F.lit(True)), "routes")
    while True:
        found = step(best.where("fresh").select("source", "node", "cost")).groupBy("source", "node").agg(better("cost").alias("new"))
        both = best.select("source", "node", "cost").join(found, ["source", "node"], "full")
        after = written(both.select("source", "node", F.least("cost", "new").alias("cost"), (F.col("cost").isNull() | (F.col("new") < F.col("cost"))).alias("fresh")), "routes")
        dropped(best)
        best = after
        if best.where("fresh").isEmpty():
            return best.select("source", "node", "cost")


def travel_times(edges: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """source, node and cost of the cheapest path of at most `most`, for edges (u, v, cost) of costs not below 0 and sources (source). Null costs are no edges."""
    edges = edges.where("cost IS NOT NULL AND cost >= 0").groupBy("u", "v").agg(F.min("cost").alias("step"))
    start = sources.where("source IS NOT NULL").select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost")).distinct()

    def step(frontier: DataFrame) -> DataFrame:
        met = frontier.join(edges, frontier["node"] == edges["u"])
        return met.select("source", F.col("v").alias("node"), (F.col("cost") + F.col("step")).alias("cost")).where(F.col("cost") <= most)

    return relaxed(start, step)


def arrivals(rides: DataFrame, starts: DataFrame, latest: int, bucket: int = 30) -> DataFrame:
    """source, node and the earliest time there, for rides (u, v, departs, arrives) in whole units of time and starts (source, at); none later than `latest`.

    From each stop to each next one only the ride that arrives first matters. It leaves in the bucket of time in which one waits, and
    rides of a stop and bucket meet by an equi-join; or later, and then it is the best of all later buckets, which is known beforehand
    from a running minimum over the buckets of each pair of stops.
    """
    at = lambda c: F.floor(c / bucket).cast("long")
    known = rides.where("departs IS NOT NULL AND arrives >= departs").where(F.col("arrives") <= latest).select("u", "v", F.col("departs").cast("long").alias("departs"), F.col("arrives").cast("long").alias("arrives"), at(F.col("departs")).alias("_b"))
    start = starts.where("source IS NOT NULL AND at IS NOT NULL").select("source", F.col("source").alias("node"), F.col("at").cast("long").alias("cost"))
    low = F.broadcast(start.agg(at(F.min("cost")).alias("_low")))  # one row
    best = known.groupBy("u", "v", "_b").agg(F.min("arrives").alias("arrives"))
    spine = known.groupBy("u", "v").agg(F.max("_b").alias("_high")).crossJoin(low).where("_low <= _high").select("u", "v", F.explode(F.sequence("_low", "_high")).alias("_b"))
    after = Window.partitionBy("u", "v").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    later = written(spine.join(best, ["u", "v", "_b"], "left").withColumn("arrives", F.min("arrives").over(after)).where("arrives IS NOT NULL"), "later")

    def step(frontier: DataFrame) -> DataFrame:
        asked = frontier.withColumn("_a", at(F.col("cost")))
        soon = asked.join(known, (asked["node"] == known["u"]) & (asked["_a"] == known["_b"])).where(F.col("departs") >= F.col("cost"))
        rest = asked.join(later, (asked["node"] == later["u"]) & (asked["_a"] == later["_b"]))
        return soon.select("source", "v", "arrives").unionByName(rest.select("source", "v", "arrives")).toDF("source", "node", "cost")

    out = relaxed(start, step)
    dropped(later)
    return out


def schedule(lines: DataFrame, headway: Column, first: Column, last: Column, stops: str, leg: Column, every: str = "line") -> DataFrame:
    """Rides (line, trip, seq, u, v, departs, arrives) of trips that leave every headway from first to last, over the legs between a line's stops.

    stops: an array of stops in order; leg: time between two of them.
    """
    trips = lines.select(every, F.explode(F.sequence(first, last, headway)).alias("_t"), F.col(stops).alias("_stops"), leg.alias("_leg"))
    trips = trips.withColumn("trip", F.row_number().over(Window.partitionBy(every).orderBy("_t")))
    legs = trips.select(every, "trip", "_t", "_leg", F.posexplode(F.arrays_zip(F.slice("_stops", 1, F.size("_stops") - 1).alias("u"), F.slice("_stops", 2, F.size("_stops")).alias("v"))).alias("seq", "_s"))
    departs = F.col("_t") + F.col("seq") * F.col("_leg")
    return legs.select(every, "trip", "seq", "_s.u", "_s.v", departs.alias("departs"), (departs + F.col("_leg")).alias("arrives"))
