"""Queries of estimators: least squares with weights, ridge and fixed effects, raking under bounds, blocked cross-validation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import boosting as B
from ..operators import estimators as E
from ..operators import sequences as Q
from ..operators.joins import densify
from ..sources.tables import table
from .analysing import rnd
from .registry import query

DAYS = """WITH n AS (SELECT event_type AS k, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS x, sum(value) AS y FROM events GROUP BY 1, 2),
    p AS (SELECT t.k, s.day, coalesce(n.x, 0) AS x, coalesce(n.y, 0) AS y FROM (SELECT DISTINCT k FROM n) t
        CROSS JOIN (SELECT CAST(unnest(generate_series((SELECT min(day) FROM n), (SELECT max(day) FROM n), INTERVAL 1 DAY)) AS DATE) AS day) s LEFT JOIN n ON n.k = t.k AND n.day = s.day)"""


@query("fe_ols_twoway", DAYS + """,
    w AS (SELECT k, x - avg(x) OVER (PARTITION BY k) - avg(x) OVER (PARTITION BY day) + avg(x) OVER () AS x, y - avg(y) OVER (PARTITION BY k) - avg(y) OVER (PARTITION BY day) + avg(y) OVER () AS y FROM p),
    f AS (SELECT sum(x * y) / sum(x * x) AS beta, sum(x * x) AS sxx, count(DISTINCT k) AS g FROM w), c AS (SELECT k, sum(x * (y - beta * x)) AS s FROM w, f GROUP BY 1)
    SELECT round(beta, 6) AS beta, round(sqrt((SELECT sum(s * s) FROM c) / (sxx * sxx) * g / (g - 1)), 6) AS se, (SELECT count(*) FROM w) AS n, g AS units FROM f""")
def fe_ols_twoway(spark, d):
    n = table(spark, d, "events").groupBy(F.col("event_type").alias("k"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("x"), F.sum("value").alias("y"))
    p = densify(n, ["k"], "day").fillna(0.0, ["x", "y"])
    return E.two_way(p, "k", "day", "x", "y").select(rnd("beta", "beta"), rnd("se", "se"), "n", "units")


@query("fe_ols_unbalanced")
def fe_ols_unbalanced(spark, d):
    """Order values on their number of lines within customers and weeks, of all orders: most customers have none in most weeks."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("unit"), F.date_trunc("week", "o_orderdate").cast("date").alias("week"), F.col("o_totalprice").alias("y"))
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("x"))
    return E.two_way_unbalanced(o.join(n, "o_orderkey"), "unit", "week", "x", "y", tolerance=1e-6).select(rnd("beta", "beta", 2), rnd("se", "se", 2), "n", "units")


@query("ols_wls", """WITH l AS (SELECT l_quantity AS x, l_extendedprice AS y, l_tax + 0.01 AS w FROM lineitem), s AS (SELECT sum(w) AS w, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * x * y) AS xy FROM l),
    b AS (SELECT *, (w * xy - x * y) / (w * xx - x * x) AS slope FROM s) SELECT round(slope, 4) AS slope, round((y - slope * x) / w, 4) AS intercept FROM b""")
def ols_wls(spark, d):
    x = table(spark, d, "lineitem")
    beta = E.least_squares(x, "l_extendedprice", ["l_quantity"], weight=F.col("l_tax") + 0.01)
    return beta.select(rnd("l_quantity", "slope", 4), rnd("intercept", "intercept", 4))


@query("ols_ridge", """WITH s AS (SELECT count(*) AS n, var_pop(l_quantity) AS a, var_pop(l_tax) AS c, covar_pop(l_quantity, l_tax) AS b, covar_pop(l_quantity, l_extendedprice) AS u, covar_pop(l_tax, l_extendedprice) AS v FROM lineitem),
    r AS (SELECT a * n + 100 AS a, c * n + 100 AS c, b * n AS b, u * n AS u, v * n AS v FROM s)
    SELECT round((u * c - v * b) / (a * c - b * b), 4) AS by_quantity, round((a * v - b * u) / (a * c - b * b), 4) AS by_tax FROM r""")
def ols_ridge(spark, d):
    beta = E.least_squares(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_tax"], ridge=100.0)
    return beta.select(rnd("l_quantity", "by_quantity", 4), rnd("l_tax", "by_tax", 4))


RATES = "SELECT n_regionkey AS g, c_custkey AS k, abs(c_acctbal) / 100 AS p, CAST(1 + c_custkey % 5 AS DOUBLE) AS w FROM customer JOIN nation ON c_nationkey = n_nationkey"


@query("benchmark_rake_clipped", f"""WITH r AS ({RATES}), o AS (SELECT g, 60.0 + 5 * g AS official FROM r GROUP BY g),
    s AS (SELECT *, sum(w) OVER d AS full_w, sum(w * p) OVER (PARTITION BY g) - sum(w * p) OVER d AS rest, sum(w) OVER (PARTITION BY g) AS all_w, lead(p) OVER (PARTITION BY g ORDER BY p DESC, k) AS below FROM r WINDOW d AS (PARTITION BY g ORDER BY p DESC, k ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT g, official, (official * all_w - 100 * full_w) / nullif(rest, 0) AS f, p, below, row_number() OVER (PARTITION BY g ORDER BY p DESC, k) AS j FROM s JOIN o USING (g)),
    z AS (SELECT g, official * sum(w) / sum(w * p) AS f, max(p) AS top FROM r JOIN o USING (g) GROUP BY g, official),
    f AS (SELECT z.g, CASE WHEN z.f * z.top <= 100 THEN z.f ELSE (SELECT c.f FROM c WHERE c.g = z.g AND c.f > 0 AND p * c.f >= 100 AND below * c.f < 100 ORDER BY j LIMIT 1) END AS f FROM z)
    SELECT k, round(least(100.0, p * f), 4) AS rate FROM r JOIN f USING (g)""")
def benchmark_rake_clipped(spark, d):
    nation = F.broadcast(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("g")))  # 25 rows
    r = table(spark, d, "customer").join(nation, "c_nationkey").select("g", F.col("c_custkey").alias("k"), (F.abs("c_acctbal") / 100).alias("p"), (1 + F.col("c_custkey") % 5).cast("double").alias("w"))
    official = r.select("g").distinct().withColumn("official", 60.0 + 5 * F.col("g"))
    return E.raked(r, official, "g", "k", "p", "w", 100.0).select("k", rnd("rate", "rate", 4))


@query("cv_blocked", """WITH l AS (SELECT year(l_shipdate) AS fold, l_quantity AS x, l_extendedprice AS y FROM lineitem), f AS (SELECT DISTINCT fold FROM l),
    m AS (SELECT f.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM f JOIN l ON l.fold <> f.fold GROUP BY 1)
    SELECT fold, count(*) AS n, round(any_value(b), 4) AS slope, round(sqrt(avg((y - a - b * x) ** 2)), 3) AS rmse FROM l JOIN m USING (fold) GROUP BY 1""")
def cv_blocked(spark, d):
    x = table(spark, d, "lineitem").select(F.year("l_shipdate").alias("fold"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return E.cross_validated(x, "fold", "x", "y").select("fold", "n", rnd("slope", "slope", 4), rnd("rmse", "rmse", 3))


@query("cv_spatial", """WITH l AS (SELECT floor(c_acctbal / 2500) * 10 + floor(c_custkey % 1000 / 250) AS fold, o_totalprice AS y, CAST(year(o_orderdate) AS DOUBLE) AS x FROM orders JOIN customer ON o_custkey = c_custkey), f AS (SELECT DISTINCT fold FROM l),
    m AS (SELECT f.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM f JOIN l ON l.fold <> f.fold GROUP BY 1)
    SELECT CAST(fold AS BIGINT) AS fold, count(*) AS n, round(any_value(b), 2) AS slope, round(sqrt(avg((y - a - b * x) ** 2)), 1) AS rmse FROM l JOIN m USING (fold) GROUP BY 1""")
def cv_spatial(spark, d):
    """Blocks of the plane that customers stand in, each predicted from all others."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.floor(F.col("c_acctbal") / 2500) * 10 + F.floor(F.col("c_custkey") % 1000 / 250)).cast("long").alias("fold"))
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").cast("double").alias("x"), F.col("o_totalprice").alias("y"))
    return E.cross_validated(o.join(c, "o_custkey"), "fold", "x", "y").select("fold", "n", rnd("slope", "slope", 2), rnd("rmse", "rmse", 1))


@query("upwind_features", """WITH s AS (SELECT event_type AS k, CAST(ts AS DATE) AS day, avg(value) AS pm, count(DISTINCT user_id) % 8 AS wind FROM events GROUP BY 1, 2),
    f AS (SELECT CAST(ts AS DATE) AS day, user_id % 8 AS sector, count(*) AS fires FROM events WHERE event_type = 'error' GROUP BY 1, 2),
    u AS (SELECT s.k, s.day, s.pm, s.wind, CAST(coalesce(sum(f.fires), 0) AS BIGINT) AS upwind FROM s LEFT JOIN f ON f.day = s.day AND (f.sector - s.wind + 9) % 8 <= 2 GROUP BY ALL)
    SELECT k, day, round(pm, 6) AS pm, upwind, round(lag(pm) OVER w, 6) AS lag1, round(CASE WHEN count(pm) OVER r >= 3 THEN avg(pm) OVER r END, 6) AS roll6, CAST(sum(upwind) OVER (PARTITION BY k ORDER BY day ROWS 2 PRECEDING) AS BIGINT) AS upwind3,
        round(sin(2 * pi() * dayofyear(day) / 365.25), 6) AS doy_sin, round(lead(pm) OVER w, 6) AS next FROM u WINDOW w AS (PARTITION BY k ORDER BY day), r AS (PARTITION BY k ORDER BY day ROWS 5 PRECEDING)""")
def upwind_features(spark, d):
    """Stations (event types) by day with what burns in the three sectors that the wind comes from, lags, rolling means and the target."""
    e = table(spark, d, "events")
    s = e.groupBy(F.col("event_type").alias("k"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("pm"), (F.count_distinct("user_id") % 8).alias("wind"))
    fires = e.where("event_type = 'error'").groupBy(F.to_date("ts").alias("day"), (F.col("user_id") % 8).alias("sector")).agg(F.count(F.lit(1)).alias("fires"))
    arc = s.withColumn("sector", F.explode(F.array(*(F.pmod(F.col("wind") + j, F.lit(8)) for j in (-1, 0, 1)))))  # the wind's sector and its neighbours
    u = arc.join(fires, ["day", "sector"], "left").groupBy("k", "day").agg(F.first("pm").alias("pm"), F.coalesce(F.sum("fires"), F.lit(0)).alias("upwind"))
    w = Window.partitionBy("k").orderBy("day")
    last6 = w.rowsBetween(-5, 0)
    return u.select(
        "k", "day", rnd("pm", "pm"), "upwind", rnd(F.lag("pm").over(w), "lag1"), rnd(F.when(F.count("pm").over(last6) >= 3, F.avg("pm").over(last6)), "roll6"),
        F.sum("upwind").over(w.rowsBetween(-2, 0)).alias("upwind3"), rnd(F.sin(2 * F.pi() * F.dayofyear("day") / 365.25), "doy_sin"), rnd(F.lead("pm").over(w), "next"),
    )


BOOST_FEATURES = ["l_quantity", "l_discount", "l_tax", "ship_days", "p_size"]


def boosting_rows(spark, d):
    """Lines with features of line and part, a price to explain, whether it was returned, and whether the line is held out."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag", F.datediff("l_shipdate", F.lit("1992-01-01")).alias("ship_days"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    line = F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "ship_days")
    return x.join(p, "l_partkey").select(line.alias("line"), *BOOST_FEATURES, F.col("l_extendedprice").alias("price"), (F.col("l_returnflag") == "R").cast("double").alias("returned"), (F.col("l_orderkey") % 5 == 0).alias("held_out"))


@query("gbt_quantile")
def gbt_quantile(spark, d):
    """Held-out lines with the 0.9 quantile of their price."""
    x = boosting_rows(spark, d)
    forest = B.fit(x.where("NOT held_out"), BOOST_FEATURES, "price", loss="quantile", quantile=0.9, trees=8)
    return B.predicted(x.where("held_out"), forest).select("line", "price", "prediction")


@query("gbt_binary")
def gbt_binary(spark, d):
    """Held-out lines with the probability that they were returned."""
    x = boosting_rows(spark, d)
    forest = B.fit(x.where("NOT held_out"), BOOST_FEATURES, "returned", loss="logistic", trees=8)
    return B.predicted(x.where("held_out"), forest).select("line", "returned", "prediction")


@query("shap_family_shares")
def shap_family_shares(spark, d):
    """The shares of amounts, rates and times in what a forest says of held-out prices, by Shapley values."""
    x = boosting_rows(spark, d)
    forest = B.fit(x.where("NOT held_out"), BOOST_FEATURES, "price", trees=8)
    values = B.shap_values(x.where("held_out"), forest, ["line"])
    return B.family_shares(values, {"amount": ["l_quantity", "p_size"], "rate": ["l_discount", "l_tax"], "time": ["ship_days"]})


@query("permutation_importance")
def permutation_importance(spark, d):
    """How much worse the held-out error of prices becomes when one feature's values change places."""
    x = boosting_rows(spark, d)
    forest = B.fit(x.where("NOT held_out"), BOOST_FEATURES, "price", trees=8)
    return B.permutation_importance(x.where("held_out"), forest, "price", "line")


@query("sequence_classes")
def sequence_classes(spark, d):
    """Users by the half of the month in which most of their events are, told from their daily counts; of held-out users."""
    e = table(spark, d, "events").select("user_id", (F.dayofmonth("ts") - 1).alias("day"))
    daily = e.groupBy("user_id", "day").agg(F.count(F.lit(1)).cast("double").alias("n"))
    late = F.sum(F.when(F.col("day") >= 15, F.col("n")).otherwise(0.0)) > F.sum(F.when(F.col("day") < 15, F.col("n")).otherwise(0.0))
    users = daily.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("day", "n"))).alias("of"), late.cast("int").alias("label"))  # at most 31 days
    users = users.select("user_id", "label", F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.coalesce(F.element_at("of", k), F.lit(0.0))).alias("series"))
    p, _ = Q.fit(users.where("user_id % 5 <> 0"), "series", "label", steps=31, classes=2, epochs=12)
    return Q.classified(users.where("user_id % 5 = 0"), p, "series", 31, ["user_id", "label"]).select("user_id", "label", "predicted", rnd("probability", "probability"))
