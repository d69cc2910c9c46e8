"""Estimators from a few sums: weighted and ridge least squares, two-way fixed effects, raking under a bound, blocked cross-validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import dropped, written


def least_squares(df: DataFrame, y: str, xs: list[str], weight: Column | None = None, ridge: float = 0.0) -> DataFrame:
    """One row: the coefficient of each of xs and the intercept, which the ridge does not shrink. Rows with a null take no part.

    One aggregation gives the normal equations, whose size follows the number of xs alone.
    """
    import numpy as np

    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.select(w.alias("_w"), *(F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate([*xs, y]))).dropna()
    n = len(xs) + 1
    means = [F.sum(F.col("_w") * F.col(f"_{k}")) / F.sum("_w") for k in range(n)]
    centre = rows.agg(*(m.alias(f"m{k}") for k, m in enumerate(means)))
    centred = rows.crossJoin(F.broadcast(centre))  # one row
    c = [F.col(f"_{k}") - F.col(f"m{k}") for k in range(n)]
    sums = centred.agg(*(F.sum(F.col("_w") * c[i] * c[j]).alias(f"s{i}_{j}") for i in range(n - 1) for j in range(i, n)), *(F.first(f"m{k}").alias(f"m{k}") for k in range(n))).first()
    a = np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] for j in range(n - 1)] for i in range(n - 1)]) + ridge * np.eye(n - 1)
    beta = np.linalg.solve(a, np.array([sums[f"s{i}_{n - 1}"] for i in range(n - 1)]))
    intercept = sums[f"m{n - 1}"] - sum(b * sums[f"m{k}"] for k, b in enumerate(beta))
    return df.sparkSession.createDataFrame([(*map(float, beta), float(intercept))], ", ".join(f"`{x}` double" for x in xs) + ", intercept double")


def two_way(panel: DataFrame, unit: str, time: str, x: str, y: str) -> DataFrame:
    """Slope of y on x within units and times, its standard error clustered by unit, n and units.

    The panel has one row for every unit and time; then one pass of demeaning is exact.
    """
    of = [F.avg(c).alias(f"{c}_{k}") for k in ("u",) for c in (x, y)]
    units = panel.groupBy(unit).agg(*of)
    times = panel.groupBy(time).agg(*(F.avg(c).alias(f"{c}_t") for c in (x, y)))
    whole = F.broadcast(panel.agg(*(F.avg(c).alias(f"{c}_g") for c in (x, y))))
    w = panel.join(units, unit).join(times, time).crossJoin(whole)
    w = w.select(unit, *((F.col(c) - F.col(f"{c}_u") - F.col(f"{c}_t") + F.col(f"{c}_g")).alias(n) for c, n in ((x, "_x"), (y, "_y"))))
    fit = w.agg((F.sum(F.col("_x") * F.col("_y")) / F.sum(F.col("_x") ** 2)).alias("beta"), F.sum(F.col("_x") ** 2).alias("sxx"), F.count(F.lit(1)).alias("n"))
    score = w.crossJoin(F.broadcast(fit)).groupBy(unit).agg(F.sum(F.col("_x") * (F.col("_y") - F.col("beta") * F.col("_x"))).alias("s"), *(F.first(c).alias(c) for c in ("beta", "sxx", "n")))
    g = F.count(F.lit(1))
    return score.agg(F.first("beta").alias("beta"), F.sqrt(F.sum(F.col("s") ** 2) / F.first("sxx") ** 2 * g / F.greatest(g - 1, F.lit(1))).alias("se"), F.first("n").alias("n"), g.alias("units"))


def two_way_unbalanced(panel: DataFrame, unit: str, time: str, x: str, y: str, tolerance: float = 1e-9, rounds: int = 1000) -> DataFrame:
    """As two_way, for panels with gaps and repeats: alternating projections until no mean of a unit or time exceeds the tolerance times the spread.

    A round takes means of units and of times out, each combined before it is shuffled, and ends in a written table. Rows with a
    null take no part. Raises if the tolerance is not reached in the given rounds.
    """
    now = written(panel.select(F.col(unit).alias("_unit"), F.col(time).alias("_time"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna(), "panel")
    spread = now.agg(*(F.stddev_pop(c).alias(c) for c in ("_x", "_y"))).first()
    scale = {c: spread[c] or 1.0 for c in ("_x", "_y")}
    for _ in range(rounds):
        after = now
        for by in ("_unit", "_time"):
            means = after.groupBy(by).agg(*(F.avg(c).alias(f"{c}_m") for c in ("_x", "_y")))
            after = after.join(means, by).select("_unit", "_time", *((F.col(c) - F.col(f"{c}_m")).alias(c) for c in ("_x", "_y")))
        after = written(after, "panel")
        dropped(now)
        now = after
        left = now.groupBy("_unit").agg(*(F.abs(F.avg(c)).alias(c) for c in ("_x", "_y"))).agg(*(F.max(c).alias(c) for c in ("_x", "_y"))).first()
        if all((left[c] or 0.0) <= tolerance * scale[c] for c in scale):
            break
    else:
        raise ValueError(f"means of units are not below {tolerance} of the spread after {rounds} rounds")
    fit = now.agg((F.sum(F.col("_x") * F.col("_y")) / F.sum(F.col("_x") ** 2)).alias("beta"), F.sum(F.col("_x") ** 2).alias("sxx"), F.count(F.lit(1)).alias("n"))
    score = now.crossJoin(F.broadcast(fit)).groupBy("_unit").agg(F.sum(F.col("_x") * (F.col("_y") - F.col("beta") * F.col("_x"))).alias("s"), *(F.first(c).alias(c) for c in ("beta", "sxx", "n")))
    g = F.count(F.lit(1))
    out = score.agg(F.first("beta").alias("beta"), F.sqrt(F.sum(F.col("s") ** 2) / F.first("sxx") ** 2 * g / F.greatest(g - 1, F.lit(1))).alias("se"), F.first("n").alias("n"), g.alias("units"))
    row = out.first()
    dropped(now)
    return panel.sparkSession.createDataFrame([tuple(row)], out.schema)


def raked(rows: DataFrame, official: DataFrame, group: str, key: str, rate: str, weight: str, top: float) -> DataFrame:
    """Rates times one factor a group, cut at top, so that their weighted mean is the group's official one.

    What cutting takes is given to the others until it fits. That end is found at once: with the j highest rates at top the
    others' factor is known from running sums, and the right j is the first where it puts the j-th rate over top and not the next;
    where only rates of 0 are left, rounding in the sums can seem to give another, huge factor.
    Official rates are below top, so at least one rate stays below it.
    """
    high = Window.partitionBy(group).orderBy(F.desc(rate), key)
    sofar = high.rowsBetween(Window.unboundedPreceding, 0)
    whole = rows.groupBy(group).agg(F.sum(weight).alias("_w"), F.sum(F.col(weight) * F.col(rate)).alias("_wp"), F.max(rate).alias("_top")).join(official, group)
    run = rows.select(group, key, rate, F.sum(weight).over(sofar).alias("_cut_w"), F.sum(F.col(weight) * F.col(rate)).over(sofar).alias("_cut_wp"), F.lead(rate).over(high).alias("_below")).join(whole, group)
    f = (F.col("official") * F.col("_w") - top * F.col("_cut_w")) / F.nullif(F.col("_wp") - F.col("_cut_wp"), F.lit(0.0))
    fits = run.withColumn("_f", f).where((F.col("_f") > 0) & (F.col(rate) * F.col("_f") >= top) & (F.col("_below") * F.col("_f") < top))
    cut = fits.groupBy(group).agg(F.min_by("_f", F.struct(-F.col(rate), F.col(key))).alias("_cut"))
    plain = F.col("official") * F.col("_w") / F.col("_wp")
    factor = whole.join(cut, group, "left").select(group, F.when(plain * F.col("_top") <= top, plain).otherwise(F.col("_cut")).alias("_factor"))
    return rows.join(factor, group).withColumn("rate", F.least(F.lit(top), F.col(rate) * F.col("_factor"))).drop("_factor")


def cross_validated(df: DataFrame, fold: str, x: str, y: str) -> DataFrame:
    """Of each fold: n, the slope fitted on all other folds, and its error on the fold. One pass: sums of the others are totals less the fold's own.

    Values are centred on their means first, so that the sums keep their digits.
    """
    mean = F.broadcast(df.agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my")))  # one row
    v = df.crossJoin(mean).select(fold, (F.col(x) - F.col("_mx")).alias("_x"), (F.col(y) - F.col("_my")).alias("_y"))
    terms = {"n": F.lit(1), "x": F.col("_x"), "y": F.col("_y"), "xx": F.col("_x") ** 2, "xy": F.col("_x") * F.col("_y"), "yy": F.col("_y") ** 2}
    own = v.groupBy(fold).agg(*(F.sum(t).alias(k) for k, t in terms.items()))
    other = own.crossJoin(F.broadcast(own.agg(*(F.sum(k).alias(f"all_{k}") for k in terms)))).select(fold, *terms, *((F.col(f"all_{k}") - F.col(k)).alias(f"o_{k}") for k in terms))
    slope = (F.col("o_n") * F.col("o_xy") - F.col("o_x") * F.col("o_y")) / (F.col("o_n") * F.col("o_xx") - F.col("o_x") ** 2)
    fit = other.withColumn("slope", slope).withColumn("a", (F.col("o_y") - F.col("slope") * F.col("o_x")) / F.col("o_n"))
    b, a = F.col("slope"), F.col("a")
    sse = F.col("yy") - 2 * a * F.col("y") - 2 * b * F.col("xy") + F.col("n") * a * a + 2 * a * b * F.col("x") + b * b * F.col("xx")
    return fit.select(fold, "n", "slope", F.sqrt(sse / F.col("n")).alias("rmse"))
