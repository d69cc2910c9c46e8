"""Weighted, distributional and tie-stable aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: About the rows of one task where groups are sorted or kept; a larger table is dealt to as many more tasks.
TASK_ROWS = 1 << 19


def dealt(df: DataFrame, by: list[str]) -> DataFrame:
    """The rows, which are counted first, dealt by key to tasks of about TASK_ROWS: what a task holds doesn't grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / TASK_ROWS)), *by)


def weighted_mean(x: str | Column, w: str | Column) -> Column:
    x, w = F.col(x) if isinstance(x, str) else x, F.col(w) if isinstance(w, str) else w
    return F.sum(x * w) / F.nullif(F.sum(w), F.lit(0.0))


def mode_smallest(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The commonest value of each group, the least of ties."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("_n"), value)).alias("mode"))


def shares(df: DataFrame, by: list[str], member: str, value: str) -> DataFrame:
    """Each member's sum, its share of the group, and its rank in it (least member first of ties)."""
    sums = df.groupBy(*by, member).agg(F.sum(value).alias("total"))
    whole = Window.partitionBy(*by)
    return sums.withColumn("share", F.col("total") / F.sum("total").over(whole)).withColumn("rank", F.row_number().over(whole.orderBy(F.desc("total"), member)))


def hhi(df: DataFrame, by: list[str], member: str, value: str) -> DataFrame:
    return shares(df, by, member, value).groupBy(*by).agg(F.sum(F.col("share") ** 2).alias("hhi"))


def topn_share(df: DataFrame, by: list[str], member: str, value: str, n: int) -> DataFrame:
    return shares(df, by, member, value).where(F.col("rank") <= n).groupBy(*by).agg(F.sum("share").alias("top_share"))


def ranked_weights(df: DataFrame, by: list[str], value: str, weight: str, tie: str) -> DataFrame:
    """Cumulative weight and weighted value shares in order of value, per group."""
    order = Window.partitionBy(*by).orderBy(value, tie)
    upto, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    mass = F.col(value) * F.col(weight)
    return (
        df.withColumn("cum_weight", F.sum(weight).over(upto) / F.sum(weight).over(whole))
        .withColumn("cum_value", F.sum(mass).over(upto) / F.sum(mass).over(whole))
        .withColumn("before_weight", F.coalesce(F.lag("cum_weight").over(order), F.lit(0.0)))
        .withColumn("before_value", F.coalesce(F.lag("cum_value").over(order), F.lit(0.0)))
    )


def gini(df: DataFrame, by: list[str], value: str, weight: str, tie: str) -> DataFrame:
    """One less twice the area under the Lorenz curve, by trapezoids."""
    area = (F.col("cum_weight") - F.col("before_weight")) * (F.col("cum_value") + F.col("before_value"))
    return ranked_weights(df, by, value, weight, tie).groupBy(*by).agg((1 - F.sum(area)).alias("gini"))


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str, tie: str) -> DataFrame:
    """The least value at which half of the weight is reached."""
    return ranked_weights(df, by, value, weight, tie).where(F.col("cum_weight") >= 0.5).groupBy(*by).agg(F.min(value).alias("weighted_median"))


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """sorted[n // 2]: the upper of the two middle values, not interpolated."""
    whole = Window.partitionBy(*by)
    ranked = df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(whole.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(whole))
    return ranked.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(*by, F.col(value).alias("median"))


def average_rank(value: str | Column, by: list[str]) -> Column:
    """Rank with ties at their mean."""
    v = F.col(value) if isinstance(value, str) else value
    ties = Window.partitionBy(*by, v)
    return F.rank().over(Window.partitionBy(*by).orderBy(v)) + (F.count(F.lit(1)).over(ties) - 1) / 2


def counted_rank(value: str, n: str, by: list[str]) -> Column:
    """Average rank where each value stands for n rows."""
    return F.sum(n).over(Window.partitionBy(*by).orderBy(value)) - (F.col(n) - 1) / 2


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Correlation of average ranks over rows that have both values; NaN, as in SQL, where all of a group's x or y are equal.

    Rows are sorted by y alone. From then on equal x of a group are one row with the count and sums of their ranks of y.
    """
    rows = dealt(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_u"), F.col(y).alias("_v")), by)
    own = rows.withColumn("_y", average_rank("_v", by)).groupBy(*by, "_u").agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_s"), F.sum(F.col("_y") ** 2).alias("_ss"), F.min("_y").alias("_least"), F.max("_y").alias("_most"))
    own = own.withColumn("_x", counted_rank("_u", "_n", by))
    n, sx, sy = F.sum("_n"), F.sum(F.col("_n") * F.col("_x")), F.sum("_s")
    spread = (n * F.sum(F.col("_n") * F.col("_x") ** 2) - sx * sx) * (n * F.sum("_ss") - sy * sy)
    varied = (F.count(F.lit(1)) > 1) & (F.min("_least") < F.max("_most"))
    return own.groupBy(*by).agg(F.when(varied, (n * F.sum(F.col("_x") * F.col("_s")) - sx * sy) / F.sqrt(spread)).otherwise(float("nan")).alias("spearman"))


def dedupe(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def cover_sets(members: DataFrame, name: str, item: str, date: str, floor: float, target: float, cap: int, least: int, near: float) -> DataFrame:
    """Sets chosen to cover the items: pick, name, cover (its share of all items), dates, and covered (the share of items that all picks so far have).

    Sets come by cover, then dates, until they cover `target` of the items or are `cap`; those under `floor` only if first. Then, up to
    `least` sets, the ones of at least `near` cover come by dates. An item is covered from the rank of the first set that has it, so
    the choice takes aggregations and no step for each pick; only sets of rank up to cap, and of the top-up, are ordered.
    """
    pairs = members.select(name, item, date).dropna(subset=[name, item])
    total = F.broadcast(pairs.agg(F.count_distinct(item).alias("_all")))  # one row
    stats = pairs.groupBy(name).agg(F.count_distinct(item).alias("_n"), F.count_distinct(date).alias("dates")).crossJoin(total)
    stats = stats.withColumn("cover", F.col("_n") / F.col("_all"))
    first = stats.orderBy(F.desc("_n"), F.desc("dates"), name).limit(cap)
    rank = Window.orderBy(F.desc("_n"), F.desc("dates"), name)
    ranked = first.withColumn("rank", F.row_number().over(rank)).where((F.col("cover") >= floor) | (F.col("rank") == 1))  # at most cap rows
    new = pairs.join(F.broadcast(ranked.select(name, "rank")), name).groupBy(item).agg(F.min("rank").alias("rank")).groupBy("rank").agg(F.count(F.lit(1)).alias("_new"))
    sofar = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    grown = ranked.join(F.broadcast(new), "rank", "left").withColumn("_sum", F.sum(F.coalesce("_new", F.lit(0))).over(sofar) / F.col("_all"))
    before = F.coalesce(F.lag("_sum").over(Window.orderBy("rank")), F.lit(0.0))
    chosen = grown.withColumn("_before", before).where(F.col("_before") < target).select(name, F.col("rank").alias("pick"), "cover", "dates")
    taken = F.broadcast(chosen.agg(F.count(F.lit(1)).alias("_taken")))
    rest = stats.where(F.col("cover") >= near).join(F.broadcast(chosen.select(name)), name, "left_anti").orderBy(F.desc("dates"), F.desc("_n"), name).limit(max(0, min(least, cap)))
    rest = rest.withColumn("_k", F.row_number().over(Window.orderBy(F.desc("dates"), F.desc("_n"), name))).crossJoin(taken).where(F.col("_taken") + F.col("_k") <= min(least, cap))
    picks = chosen.unionByName(rest.select(name, (F.col("_taken") + F.col("_k")).cast("int").alias("pick"), "cover", "dates"))  # at most cap rows
    got = pairs.join(F.broadcast(picks.select(name, "pick")), name).groupBy(item).agg(F.min("pick").alias("pick")).groupBy("pick").agg(F.count(F.lit(1)).alias("_new"))
    covered = F.sum(F.coalesce("_new", F.lit(0))).over(Window.orderBy("pick").rowsBetween(Window.unboundedPreceding, 0)) / F.col("_all")
    return picks.join(F.broadcast(got), "pick", "left").crossJoin(total).select("pick", name, "cover", "dates", covered.alias("covered"))
