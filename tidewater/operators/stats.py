"""Statistics as relational operators: ranks, fits, decompositions, balances and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import counted_rank


def auc(df: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    """Area under the curve by average ranks: ties count half. Equal scores of a group are counted before they are ranked."""
    counts = df.groupBy(*by, F.col(score).alias("_v")).agg(F.count(F.lit(1)).alias("_n"), F.sum(positive.cast("double")).alias("_p"))
    ranked = counts.withColumn("_r", counted_rank("_v", "_n", by))
    p, n = F.sum("_p"), F.sum("_n") - F.sum("_p")
    value = (F.sum(F.col("_r") * F.col("_p")) - p * (p + 1) / 2) / F.nullif(p * n, F.lit(0.0))
    return ranked.groupBy(*by).agg(value.alias("auc"))


def advantage(df: DataFrame, who: str, what: str, value: str) -> DataFrame:
    """Revealed comparative advantage: the share of what in who over its share in all."""
    sums = df.groupBy(who, what).agg(F.sum(value).alias("v"))
    who_total, what_total = sums.groupBy(who).agg(F.sum("v").alias("vw")), sums.groupBy(what).agg(F.sum("v").alias("vp"))
    whole = sums.agg(F.sum("v").alias("all"))
    joined = sums.join(who_total, who).join(what_total, what).crossJoin(F.broadcast(whole))
    return joined.select(who, what, (F.col("v") / F.col("vw") / (F.col("vp") / F.col("all"))).alias("rca"))


def proximity(df: DataFrame, who: str, what: str) -> DataFrame:
    """Of items a < b: how many have both over how many have the commoner one."""
    has = df.select(who, what).distinct()
    k = has.groupBy(what).agg(F.count(F.lit(1)).alias("k"))
    both = has.select(who, F.col(what).alias("a")).join(has.select(who, F.col(what).alias("b")), who).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return both.join(k.select(F.col(what).alias("a"), F.col("k").alias("ka")), "a").join(k.select(F.col(what).alias("b"), F.col("k").alias("kb")), "b").select("a", "b", (F.col("n") / F.greatest("ka", "kb")).alias("phi"))


def within_slope(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """One-way fixed effects: the slope of y on x after group means are taken out, and its count."""
    w = Window.partitionBy(group)
    d = df.select((F.col(x) - F.avg(x).over(w)).alias("dx"), (F.col(y) - F.avg(y).over(w)).alias("dy"))
    return d.agg((F.sum(F.col("dx") * F.col("dy")) / F.sum(F.col("dx") ** 2)).alias("slope"), F.count(F.lit(1)).alias("n"))


def shrunk(groups: DataFrame, mean: str, variance: str, between: Column) -> DataFrame:
    """Group means drawn to the mean of means by precision: weight between / (between + variance)."""
    grand = F.broadcast(groups.agg(F.avg(mean).alias("_grand"), between.alias("_between")))
    weight = F.col("_between") / (F.col("_between") + F.col(variance))
    return groups.crossJoin(grand).withColumn("shrunk", weight * F.col(mean) + (1 - weight) * F.col("_grand")).drop("_grand", "_between")


def errors(truth: str, guess: str) -> list[Column]:
    """MAE, RMSE, bias."""
    d = F.col(guess) - F.col(truth)
    return [F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias")]


def gate(df: DataFrame, name: str, value: Column, least: float, n: Column | None = None, enough: int = 1) -> DataFrame:
    """One row of a check: its value, its threshold, and pass, fail or insufficient."""
    n = n if n is not None else F.count(F.lit(1))
    row = df.agg(F.lit(name).alias("gate"), value.cast("double").alias("value"), F.lit(float(least)).alias("threshold"), n.alias("n"))
    return row.withColumn("status", F.when(F.col("n") < enough, "insufficient").when(F.col("value") >= F.col("threshold"), "pass").otherwise("fail"))
