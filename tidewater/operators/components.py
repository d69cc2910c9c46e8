"""Graphs as edge tables: connected components and maximum spanning forests, by rounds of aggregations and joins.

Each round ends in a table written to the shared checkpoint folder, so plans stay short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dropped, written


def star(links: DataFrame, large: bool) -> DataFrame:
    """Links u > v turned towards the least neighbour: of all neighbours, or of the smaller ones."""
    if large:
        near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
        moved = near.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("least"))
        joined = links.join(least, "u")
        moved = joined.select(F.explode(F.array(F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("x")).select("x.*")
    return moved.where(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node and label, the least node of its component, for nodes that stand in a link between different nodes.

    Alternating large and small stars: two aggregations and two joins a round, one written table a round, and rounds that
    grow with the logarithm of the longest path. A node with very many links is one side's single row in a join whose other
    side Spark splits where it is skewed.
    """
    now = written(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    state = None
    while True:
        after = written(star(star(now, large=True), large=False), "links")
        dropped(now)
        now = after
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == state:
            break
        state = seen
    least = now.groupBy("u").agg(F.min("v").alias("label"))
    return least.unionByName(least.select(F.col("label").alias("u"), "label").distinct()).select(F.col("u").alias("node"), "label")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b, w) of a maximum spanning forest: in each round every component takes its heaviest edge outwards."""
    edges = written(edges.select("a", "b", "w"))
    labels = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")))
    chosen = None
    while True:
        la, lb = labels.withColumnsRenamed({"node": "a", "label": "la"}), labels.withColumnsRenamed({"node": "b", "label": "lb"})
        out = edges.join(la, "a").join(lb, "b").where("la <> lb")
        order = F.struct("w", "a", "b", "la", "lb")
        best = written(out.select(F.explode(F.array("la", "lb")).alias("label"), order.alias("e")).groupBy("label").agg(F.max("e").alias("e")).select("e.*").distinct())
        if not best.limit(1).count():
            return chosen if chosen is not None else edges.limit(0)
        picked = best.select("a", "b", "w")
        chosen = written(picked if chosen is None else chosen.unionByName(picked).distinct())
        merged = components(best, "la", "lb").select(F.col("node").alias("label"), F.col("label").alias("to"))
        labels = written(labels.join(merged, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
