"""Queries of statistics, decompositions, graphs and data-quality gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import routes as R
from ..operators import stats as S
from ..operators.components import components, spanning_forest
from ..operators.estimators import least_squares
from ..operators.joins import neighbours
from ..sources.arrays import array_window, packed_arrays
from ..sources.shared import written
from ..sources.tables import table, zip_csv, zipped
from .registry import query
from .streams import shared
from .windowing import DAILY, PANEL, by, daily, panel


def rnd(c, name, digits=6):
    return F.round(c, digits).alias(name)


@query("ols_simple", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def ols_simple(spark, d):
    y, x = "l_extendedprice", "l_quantity"
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(rnd(F.regr_slope(y, x), "slope"), rnd(F.regr_intercept(y, x), "intercept"), rnd(F.regr_r2(y, x), "r2"))


@query("fe_ols_oneway", "WITH w AS (SELECT l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey) AS dx, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS dy FROM lineitem) SELECT round(sum(dx * dy) / sum(dx * dx), 4) AS slope, count(*) AS n FROM w")
def fe_ols_oneway(spark, d):
    return S.within_slope(table(spark, d, "lineitem"), "l_suppkey", "l_quantity", "l_extendedprice").select(rnd("slope", "slope", 4), "n")


def cramer(xs: str, y: str) -> str:
    """Three slopes by determinants of covariances."""
    x = xs.split()
    c = {(i, j): f"covar_pop({x[i]}, {x[j]})" for i in range(3) for j in range(3)}
    det = lambda m: f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
    names = [[f"c{i}{j}" for j in range(3)] for i in range(3)]
    sums = ", ".join([*(f"{c[i, j]} AS c{i}{j}" for i, j in c), *(f"covar_pop({x[i]}, {y}) AS u{i}" for i in range(3)), *(f"avg({n}) AS m{k}" for k, n in enumerate([*x, y]))])
    swapped = lambda k: [[f"u{i}" if j == k else names[i][j] for j in range(3)] for i in range(3)]
    betas = ", ".join(f"{det(swapped(k))} / {det(names)} AS b{k}" for k in range(3))
    return f"WITH s AS (SELECT {sums} FROM lineitem), b AS (SELECT *, {betas} FROM s)"


@query("ols_multi", cramer("l_quantity l_discount l_tax", "l_extendedprice") + " SELECT unnest(['intercept', 'l_quantity', 'l_discount', 'l_tax']) AS term, unnest([round(m3 - b0 * m0 - b1 * m1 - b2 * m2, 3), round(b0, 3), round(b1, 3), round(b2, 3)]) AS beta FROM b")
def ols_multi(spark, d):
    beta = least_squares(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return beta.unpivot([], ["intercept", "l_quantity", "l_discount", "l_tax"], "term", "beta").select("term", rnd("beta", "beta", 3))


@query("predict_band", """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem), s AS (SELECT sqrt(sum((l_extendedprice - a - b * l_quantity) ** 2) / (count(*) - 2)) AS s FROM lineitem, f)
    SELECT q, round(a + b * q, 4) AS fit, round(a + b * q - 1.96 * s, 4) AS low, round(a + b * q + 1.96 * s, 4) AS high FROM f, s, (VALUES (10), (25), (40)) v(q)""")
def predict_band(spark, d):
    x = table(spark, d, "lineitem")
    f = x.agg(F.regr_slope("l_extendedprice", "l_quantity").alias("b"), F.regr_intercept("l_extendedprice", "l_quantity").alias("a"))
    r = F.col("l_extendedprice") - F.col("a") - F.col("b") * F.col("l_quantity")
    s = x.crossJoin(F.broadcast(f)).agg(F.sqrt(F.sum(r * r) / (F.count(F.lit(1)) - 2)).alias("s"))
    both = f.crossJoin(s).withColumn("q", F.explode(F.array(*(F.lit(v) for v in (10, 25, 40)))))
    fit = F.col("a") + F.col("b") * F.col("q")
    return both.select("q", rnd(fit, "fit", 4), rnd(fit - 1.96 * F.col("s"), "low", 4), rnd(fit + 1.96 * F.col("s"), "high", 4))


@query("eb_shrink", """WITH g AS (SELECT c_nationkey AS k, avg(c_acctbal) AS m, var_samp(c_acctbal) / count(*) AS v FROM customer GROUP BY 1 HAVING count(*) > 1), t AS (SELECT avg(m) AS gm, greatest(var_samp(m) - avg(v), 1) AS b FROM g)
    SELECT k, round(b / (b + v) * m + (1 - b / (b + v)) * gm, 4) AS shrunk FROM g, t""")
def eb_shrink(spark, d):
    g = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("m"), (F.var_samp("c_acctbal") / F.count(F.lit(1))).alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return S.shrunk(g, "m", "v", F.greatest(F.var_samp("m") - F.avg("v"), F.lit(1.0))).select("k", rnd("shrunk", "shrunk", 4))


@query("forecast_metrics", PANEL + ", f AS (SELECT k, day, n, lag(n) OVER (PARTITION BY k ORDER BY day) AS g FROM p) SELECT k, round(avg(abs(g - n)), 6) AS mae, round(sqrt(avg((g - n) ** 2)), 6) AS rmse, round(avg(g - n), 6) AS bias FROM f WHERE g IS NOT NULL GROUP BY 1")
def forecast_metrics(spark, d):
    f = panel(spark, d).withColumn("g", F.lag("n").over(by())).where("g IS NOT NULL").groupBy("k").agg(*S.errors("n", "g"))
    return f.select("k", *(rnd(c, c) for c in ("mae", "rmse", "bias")))


@query("baseline_climatology", """WITH c AS (SELECT hour(ts) AS h, avg(value) AS m FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1), g AS (SELECT avg(value) AS g FROM events WHERE ts < TIMESTAMP '2024-01-20')
    SELECT event_id, round(value - coalesce(m, g), 6) AS anomaly FROM events CROSS JOIN g LEFT JOIN c ON c.h = hour(ts) WHERE ts >= TIMESTAMP '2024-01-20'""")
def baseline_climatology(spark, d):
    e = table(spark, d, "events").withColumn("h", F.hour("ts"))
    cut = F.expr("TIMESTAMP_NTZ '2024-01-20'")
    train = e.where(F.col("ts") < cut)
    c, g = F.broadcast(train.groupBy("h").agg(F.avg("value").alias("m"))), F.broadcast(train.agg(F.avg("value").alias("g")))
    return e.where(F.col("ts") >= cut).join(c, "h", "left").crossJoin(g).select("event_id", rnd(F.col("value") - F.coalesce("m", "g"), "anomaly"))


@query("brier_reliability", """WITH s AS (SELECT l_discount * 10 AS p, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem) SELECT CAST(least(floor(p * 5), 4) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 6) AS p, round(avg(y), 6) AS y, round(avg((p - y) ** 2), 6) AS brier FROM s GROUP BY 1""")
def brier_reliability(spark, d):
    s = table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("p"), (F.col("l_returnflag") == "R").cast("double").alias("y"))
    return s.groupBy(F.least(F.floor(F.col("p") * 5), F.lit(4)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("p"), "p"), rnd(F.avg("y"), "y"), rnd(F.avg((F.col("p") - F.col("y")) ** 2), "brier"))


AUC = """WITH r AS (SELECT {g} AS g, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, rank() OVER (PARTITION BY {g} ORDER BY l_quantity) + (count(*) OVER (PARTITION BY {g}, l_quantity) - 1) / 2 AS r FROM lineitem)
    SELECT g, round((sum(r * y) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auc FROM r GROUP BY 1"""


@query("auc_grouped", AUC.format(g="l_suppkey"))
def auc_grouped(spark, d):
    x = table(spark, d, "lineitem").withColumn("g", F.col("l_suppkey"))
    return S.auc(x, ["g"], "l_quantity", F.col("l_returnflag") == "R").select("g", rnd("auc", "auc"))


@query("auc_rank", AUC.format(g="l_linestatus"))
def auc_rank(spark, d):
    # few groups: average ranks come from counts by value, so no window holds a whole group
    x = table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("g"), "l_quantity").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("p"))
    upto = F.sum("n").over(Window.partitionBy("g").orderBy("l_quantity"))
    ranked = x.withColumn("r", upto - (F.col("n") - 1) / 2)
    p, n = F.sum("p"), F.sum("n") - F.sum("p")
    return ranked.groupBy("g").agg(rnd((F.sum(F.col("r") * F.col("p")) - p * (p + 1) / 2) / (p * n), "auc"))


@query("average_precision", "WITH r AS (SELECT l_suppkey, l_returnflag = 'R' AS y, row_number() OVER w AS k, sum(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS h FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)) SELECT l_suppkey, round(avg(h / k), 6) AS ap FROM r WHERE y GROUP BY 1")
def average_precision(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    y = F.col("l_returnflag") == "R"
    r = table(spark, d, "lineitem").withColumn("k", F.row_number().over(w)).withColumn("h", F.sum(y.cast("double")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.where(y).groupBy("l_suppkey").agg(rnd(F.avg(F.col("h") / F.col("k")), "ap"))


@query("bootstrap_blocks")
def bootstrap_blocks(spark, d):
    blocks = daily(spark, d).groupBy("day").agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("c"))
    # Poisson(1) weights from a hash of block and replicate: the same in every run and on any number of executors
    u = F.pmod(F.xxhash64("day", "rep"), F.lit(1_000_003)) / 1_000_003
    weight = F.when(u < 0.3679, 0).when(u < 0.7358, 1).when(u < 0.9197, 2).when(u < 0.9810, 3).when(u < 0.9963, 4).otherwise(5)
    reps = blocks.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(200)))).withColumn("w", weight)
    means = reps.groupBy("rep").agg((F.sum(F.col("s") * F.col("w")) / F.nullif(F.sum(F.col("c") * F.col("w")), F.lit(0))).alias("m"))
    return means.agg(F.percentile("m", [0.025, 0.5, 0.975]).alias("q")).select(*(F.col("q")[k].alias(n) for k, n in enumerate(("low", "median", "high"))))


@query("acf", PANEL + " , a AS (SELECT k, l, n, lag(n, CAST(l AS INTEGER)) OVER (PARTITION BY k, l ORDER BY day) AS b FROM p CROSS JOIN (VALUES (1), (2), (7)) v(l)) SELECT k, l, round(corr(n, b), 6) AS r FROM a WHERE b IS NOT NULL GROUP BY 1, 2")
def acf(spark, d):
    p = panel(spark, d)
    for h in (1, 2, 7):
        p = p.withColumn(f"b{h}", F.lag("n", h).over(by()))
    c = p.groupBy("k").agg(*(F.round(F.corr("n", f"b{h}"), 6).alias(str(h)) for h in (1, 2, 7)))
    return c.select("k", F.inline(F.array(*(F.struct(F.lit(h).alias("l"), F.col(str(h)).alias("r")) for h in (1, 2, 7)))))


YEARS = "y AS (SELECT o_custkey AS k, sum(CASE WHEN year(o_orderdate) = 1997 THEN o_totalprice END) AS a, sum(CASE WHEN year(o_orderdate) = 1998 THEN o_totalprice END) AS b FROM orders WHERE year(o_orderdate) IN (1997, 1998) GROUP BY 1)"


def two_years(spark, d):
    y = F.year("o_orderdate")
    o = table(spark, d, "orders").where(y.isin(1997, 1998))
    return o.groupBy(F.col("o_custkey").alias("k")).agg(F.sum(F.when(y == 1997, F.col("o_totalprice"))).alias("a"), F.sum(F.when(y == 1998, F.col("o_totalprice"))).alias("b"))


@query("decomp_griliches_regev", f"WITH {YEARS} SELECT round(sum(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b - a END), 2) AS within, round(sum(CASE WHEN a IS NULL THEN b END), 2) AS entry, round(-sum(CASE WHEN b IS NULL THEN a END), 2) AS exit, round(coalesce(sum(b), 0) - coalesce(sum(a), 0), 2) AS total FROM y")
def decomp_griliches_regev(spark, d):
    a, b = F.col("a"), F.col("b")
    return two_years(spark, d).agg(
        rnd(F.sum(F.when(a.isNotNull() & b.isNotNull(), b - a)), "within", 2), rnd(F.sum(F.when(a.isNull(), b)), "entry", 2), rnd(-F.sum(F.when(b.isNull(), a)), "exit", 2), rnd(F.coalesce(F.sum(b), F.lit(0.0)) - F.coalesce(F.sum(a), F.lit(0.0)), "total", 2)
    )


@query("decomp_log", """WITH y AS (SELECT l_suppkey, year(l_shipdate) AS y, sum(l_extendedprice) AS v, sum(l_quantity) AS q FROM lineitem WHERE year(l_shipdate) IN (1997, 1998) GROUP BY 1, 2)
    SELECT l_suppkey, round(ln(b.v / a.v), 6) AS value, round(ln(b.q / a.q), 6) AS volume, round(ln(b.v / b.q) - ln(a.v / a.q), 6) AS price FROM y a JOIN y b USING (l_suppkey) WHERE a.y = 1997 AND b.y = 1998""")
def decomp_log(spark, d):
    y = F.year("l_shipdate")
    of = lambda c, n: F.sum(F.when(y == n, F.col(c)))
    s = table(spark, d, "lineitem").where(y.isin(1997, 1998)).groupBy("l_suppkey").agg(of("l_extendedprice", 1997).alias("v0"), of("l_extendedprice", 1998).alias("v1"), of("l_quantity", 1997).alias("q0"), of("l_quantity", 1998).alias("q1"))
    s = s.where("v0 IS NOT NULL AND v1 IS NOT NULL")
    return s.select("l_suppkey", rnd(F.log(F.col("v1") / F.col("v0")), "value"), rnd(F.log(F.col("q1") / F.col("q0")), "volume"), rnd(F.log(F.col("v1") / F.col("q1")) - F.log(F.col("v0") / F.col("q0")), "price"))


@query("rca", """WITH s AS (SELECT l_suppkey, l_returnflag, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, l_returnflag, round(v / sum(v) OVER (PARTITION BY l_suppkey) / (sum(v) OVER (PARTITION BY l_returnflag) / sum(v) OVER ()), 6) AS rca FROM s""")
def rca(spark, d):
    return S.advantage(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag", "l_extendedprice").withColumn("rca", F.round("rca", 6))


PHI = """WITH h AS (SELECT DISTINCT c_nationkey, p_brand FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey WHERE l_quantity > 48),
    k AS (SELECT p_brand, count(*) AS k FROM h GROUP BY 1), n AS (SELECT a.p_brand AS a, b.p_brand AS b, count(*) AS n FROM h a JOIN h b ON a.c_nationkey = b.c_nationkey AND a.p_brand < b.p_brand GROUP BY 1, 2)
    SELECT a, b, round(n / greatest(x.k, y.k), 6) AS phi FROM n JOIN k x ON x.p_brand = a JOIN k y ON y.p_brand = b"""


def brand_holders(spark, d):
    line = table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    joined = line.join(orders, "o_orderkey").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    return joined.select("c_nationkey", "p_brand").distinct()


@query("proximity_phi", PHI)
def proximity_phi(spark, d):
    return S.proximity(brand_holders(spark, d), "c_nationkey", "p_brand").withColumn("phi", F.round("phi", 6))


@query("max_spanning_tree")
def max_spanning_tree(spark, d):
    return spanning_forest(S.proximity(brand_holders(spark, d), "c_nationkey", "p_brand").withColumnRenamed("phi", "w"))


@query("connected_components", """WITH RECURSIVE e AS (SELECT DISTINCT a.user_id AS u, b.user_id AS v FROM events a JOIN events b ON a.user_id <> b.user_id AND CAST(a.ts AS DATE) = CAST(b.ts AS DATE) AND a.event_type = 'error' AND b.event_type = 'error' AND abs(a.value - b.value) < 0.02),
    n AS (SELECT DISTINCT u FROM e), r(u, v) AS (SELECT u, u FROM n UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v) SELECT u AS node, min(v) AS label FROM r GROUP BY 1""")
def connected_components(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'").select("user_id", F.to_date("ts").alias("day"), "value", F.floor(F.col("value") / 0.02).alias("x"), F.lit(0).alias("y"))
    near = neighbours(e, "x", "y").select(F.col("user_id").alias("v"), "day", F.col("value").alias("other"), "x", "y").where("y = 0")
    links = e.join(near, ["day", "x"]).where((F.col("user_id") < F.col("v")) & (F.abs(F.col("value") - F.col("other")) < 0.02)).select(F.col("user_id").alias("u"), "v").distinct()
    return components(links, "u", "v")


@query("greedy_cover")
def greedy_cover(spark, d):
    """Sets of nations by brand, picked until none adds a nation; each step is one aggregation, the number of picks is bounded by the nations."""
    h = written(brand_holders(spark, d).withColumnsRenamed({"p_brand": "set", "c_nationkey": "item"}))
    picked = []
    while len(picked) < 25:
        best = h.groupBy("set").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "set").first()
        if best is None:
            break
        picked.append((len(picked) + 1, best["set"], best["n"]))
        h = written(h.join(h.where(F.col("set") == best["set"]).select("item"), "item", "left_anti"))
    return spark.createDataFrame(picked, "pick int, set string, added long")


def filled_once(c: str, m: str, out: str) -> str:
    return f"""{m} AS (SELECT x + i AS x, y + j AS y, sum(v) AS s, count(*) AS n FROM {c} CROSS JOIN (VALUES (-1), (0), (1)) a(i) CROSS JOIN (VALUES (-1), (0), (1)) b(j) GROUP BY 1, 2),
    {out} AS (SELECT x, y, coalesce(c.v, CAST(floor(m.s / m.n) AS BIGINT)) AS v FROM {m} m LEFT JOIN {c} c USING (x, y) WHERE c.v IS NOT NULL OR m.n >= 3)"""


@query("focal_fill", "WITH c AS (SELECT CAST(floor(c_acctbal / 500) AS BIGINT) AS x, CAST(c_nationkey AS BIGINT) AS y, CAST(floor(sum(CAST(round(c_acctbal * 100) AS BIGINT)) / count(*)) AS BIGINT) AS v FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1, 2), " + filled_once("c", "m", "d") + ", " + filled_once("d", "k", "e") + " SELECT x, y, v FROM e")
def focal_fill(spark, d):
    """Empty cells with at least three known neighbours get their mean, in two passes. Values are whole cents, so sums have no order."""
    c = table(spark, d, "customer").where("c_custkey % 3 <> 0").groupBy(F.floor(F.col("c_acctbal") / 500).alias("x"), F.col("c_nationkey").cast("long").alias("y"))
    c = c.agg(F.floor(F.sum(F.round(F.col("c_acctbal") * 100).cast("long")) / F.count(F.lit(1))).alias("v"))
    for _ in range(2):
        m = neighbours(c, "x", "y").groupBy("x", "y").agg(F.floor(F.sum("v") / F.count(F.lit(1))).alias("m"), F.count(F.lit(1)).alias("n"))
        c = m.join(c, ["x", "y"], "left").where("v IS NOT NULL OR n >= 3").select("x", "y", F.coalesce("v", "m").alias("v"))
    return c


@query("persistent_mask", """WITH m AS (SELECT user_id AS x, 0 AS y FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(DISTINCT CAST(date_trunc('week', ts) AS DATE)) >= 3) SELECT x + i AS x, max(CASE WHEN i = 0 THEN 1 ELSE 0 END) AS core FROM m CROSS JOIN (VALUES (-1), (0), (1)) o(i) GROUP BY 1""")
def persistent_mask(spark, d):
    m = table(spark, d, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("x")).agg(F.count_distinct(F.date_trunc("week", "ts")).alias("n")).where("n >= 3")
    near = m.select(F.explode(F.array(*(F.struct((F.col("x") + k).alias("x"), F.lit(int(k == 0)).alias("core")) for k in (-1, 0, 1)))).alias("c"))
    return near.groupBy("c.x").agg(F.max("c.core").alias("core"))


@query("attribution_shares", "WITH v AS (SELECT l_orderkey AS o, l_suppkey AS s, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT s, round(sum(q) / (SELECT sum(q) FROM v), 8) AS share, count(DISTINCT o) AS orders FROM v GROUP BY 1")
def attribution_shares(spark, d):
    v = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(F.sum("l_quantity").alias("q"), F.count_distinct("l_orderkey").alias("orders"))
    return v.crossJoin(F.broadcast(v.agg(F.sum("q").alias("whole")))).select("s", rnd(F.col("q") / F.col("whole"), "share", 8), "orders")


@query("exposure_timeseries", "SELECT t, h, count(*) FILTER (WHERE c_acctbal - 120 * t < h) AS exposed FROM customer CROSS JOIN (SELECT unnest(range(0, 10)) AS t) y CROSS JOIN (VALUES (0), (1000)) v(h) GROUP BY 1, 2")
def exposure_timeseries(spark, d):
    c = table(spark, d, "customer").select("c_acctbal")
    grid = [(t, h) for t in range(10) for h in (0, 1000)]
    wide = c.agg(*(F.count_if(F.col("c_acctbal") - 120 * t < h).alias(f"{t}_{h}") for t, h in grid))  # one pass for all twenty cells
    return wide.select(F.inline(F.array(*(F.struct(F.lit(t).cast("long").alias("t"), F.lit(h).alias("h"), F.col(f"{t}_{h}").alias("exposed")) for t, h in grid))))


@query("benchmark_rake", """WITH o AS (SELECT n_regionkey AS g, 5000.0 + n_regionkey AS official FROM nation GROUP BY 1, 2), m AS (SELECT n_regionkey AS g, c_custkey, abs(c_acctbal) AS x, avg(abs(c_acctbal)) OVER (PARTITION BY n_regionkey) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey, round(least(x * official / m, 9999.0), 4) AS x FROM m JOIN o USING (g)""")
def benchmark_rake(spark, d):
    g = F.broadcast(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("g")))
    m = table(spark, d, "customer").join(g, "c_nationkey").select("g", "c_custkey", F.abs("c_acctbal").alias("x"))
    factor = m.groupBy("g").agg(((5000.0 + F.col("g")) / F.avg("x")).alias("f"))
    return m.join(F.broadcast(factor), "g").select("c_custkey", rnd(F.least(F.col("x") * F.col("f"), F.lit(9999.0)), "x", 4))


@query("cv_folds", "SELECT o_orderkey, CASE WHEN month(o_orderdate) >= 7 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS season, o_custkey % 5 AS fold FROM orders")
def cv_folds(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (F.year("o_orderdate") - (F.month("o_orderdate") < 7).cast("int")).alias("season"), (F.col("o_custkey") % 5).alias("fold"))


@query("standardize_train", "WITH t AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem WHERE l_orderkey % 5 <> 0) SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 6) AS z FROM lineitem CROSS JOIN t")
def standardize_train(spark, d):
    x = table(spark, d, "lineitem")
    t = F.broadcast(x.where("l_orderkey % 5 <> 0").agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("s")))
    return x.crossJoin(t).select("l_orderkey", "l_linenumber", rnd((F.col("l_quantity") - F.col("m")) / F.col("s"), "z"))


@query("fourier_power", PANEL + ", t AS (SELECT k, n, date_diff('day', DATE '2024-01-01', day) AS t FROM p) SELECT k, round(sum(n * cos(2 * pi() * t / 7)) ** 2 + sum(n * sin(2 * pi() * t / 7)) ** 2, 4) AS weekly FROM t GROUP BY 1")
def fourier_power(spark, d):
    a = 2 * F.pi() * F.datediff("day", F.to_date(F.lit("2024-01-01"))) / 7
    part = lambda f: F.sum(F.col("n") * f(a)) ** 2
    return panel(spark, d).groupBy("k").agg(rnd(part(F.cos) + part(F.sin), "weekly", 4))


@query("circular_xcorr", """WITH m AS (SELECT l_returnflag AS f, month(l_shipdate) - 1 AS m, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2), x AS (SELECT s.s, corr(a.q, b.q) AS r FROM m a CROSS JOIN (SELECT unnest(range(0, 12)) AS s) s JOIN m b ON b.f = 'R' AND b.m = (a.m + s.s) % 12 WHERE a.f = 'A' GROUP BY 1)
    SELECT s AS shift, round(r, 6) AS r FROM x""")
def circular_xcorr(spark, d):
    m = table(spark, d, "lineitem").where("l_returnflag IN ('A', 'R')").groupBy((F.month("l_shipdate") - 1).alias("m"), "l_returnflag").agg(F.avg("l_quantity").alias("q"))
    a = m.where("l_returnflag = 'A'").select("m", F.col("q").alias("a")).withColumn("shift", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))))
    b = m.where("l_returnflag = 'R'").select(F.col("m").alias("at"), F.col("q").alias("b"))
    return a.withColumn("at", ((F.col("m") + F.col("shift")) % 12).cast("int")).join(b, "at").groupBy("shift").agg(rnd(F.corr("a", "b"), "r"))


@query("scenario_sweep", "SELECT c_nationkey, f, round(sum(c_acctbal * f), 2) AS total FROM customer CROSS JOIN (VALUES (0.9), (1.0), (1.1)) v(f) GROUP BY 1, 2")
def scenario_sweep(spark, d):
    s = table(spark, d, "customer").groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("s"))
    return s.select("c_nationkey", F.explode(F.array(*(F.lit(f) for f in (0.9, 1.0, 1.1)))).alias("f"), "s").select("c_nationkey", "f", rnd(F.col("s") * F.col("f"), "total", 2))


@query("prf1", "WITH s AS (SELECT l_quantity > 40 AS g, l_returnflag = 'R' AS y FROM lineitem), c AS (SELECT count(*) FILTER (WHERE g AND y) AS tp, count(*) FILTER (WHERE g AND NOT y) AS fp, count(*) FILTER (WHERE NOT g AND y) AS fn FROM s) SELECT tp / (tp + fp) AS p, tp / (tp + fn) AS r, round(2.0 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c")
def prf1(spark, d):
    g, y = F.col("l_quantity") > 40, F.col("l_returnflag") == "R"
    c = table(spark, d, "lineitem").agg(F.count_if(g & y).alias("tp"), F.count_if(g & ~y).alias("fp"), F.count_if(~g & y).alias("fn"))
    return c.select((F.col("tp") / (F.col("tp") + F.col("fp"))).alias("p"), (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("r"), rnd(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), "f1", 9))


@query("spike_decomp", DAILY.replace("WITH n", "WITH m") + ", t AS (SELECT day, sum(n) AS v, count(*) AS users FROM m GROUP BY 1), b AS (SELECT day, v, users, avg(v) OVER w AS bv, avg(users) OVER w AS bu FROM t WINDOW w AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) SELECT day, round(ln(v / bv), 6) AS value, round(ln(users / bu), 6) AS numerator FROM b WHERE bv IS NOT NULL")
def spike_decomp(spark, d):
    t = daily(spark, d).groupBy("day").agg(F.sum("n").alias("v"), F.count(F.lit(1)).alias("users"))
    w = Window.orderBy("day").rowsBetween(-7, -1)  # one row a day
    b = t.withColumn("bv", F.avg("v").over(w)).withColumn("bu", F.avg("users").over(w)).where("bv IS NOT NULL")
    return b.select("day", rnd(F.log(F.col("v") / F.col("bv")), "value"), rnd(F.log(F.col("users") / F.col("bu")), "numerator"))


@query("corr_within", "WITH w AS (SELECT year(l_shipdate) AS y, l_quantity - avg(l_quantity) OVER (PARTITION BY year(l_shipdate)) AS a, l_discount - avg(l_discount) OVER (PARTITION BY year(l_shipdate)) AS b FROM lineitem) SELECT round(corr(a, b), 6) AS r FROM w")
def corr_within(spark, d):
    x = table(spark, d, "lineitem").withColumn("y", F.year("l_shipdate"))
    means = F.broadcast(x.groupBy("y").agg(F.avg("l_quantity").alias("mq"), F.avg("l_discount").alias("md")))  # a row a year
    return x.join(means, "y").agg(rnd(F.corr(F.col("l_quantity") - F.col("mq"), F.col("l_discount") - F.col("md")), "r"))


@query("gate_table", """SELECT 'orders' AS gate, CAST(count(*) AS DOUBLE) AS value, 100.0 AS threshold, count(*) AS n, CASE WHEN count(*) < 1 THEN 'insufficient' WHEN count(*) >= 100 THEN 'pass' ELSE 'fail' END AS status FROM orders
    UNION ALL SELECT 'priority', avg(CASE WHEN o_orderpriority IS NULL THEN 0.0 ELSE 1.0 END), 0.99, count(*), CASE WHEN count(*) < 1 THEN 'insufficient' WHEN avg(CASE WHEN o_orderpriority IS NULL THEN 0.0 ELSE 1.0 END) >= 0.99 THEN 'pass' ELSE 'fail' END FROM orders""")
def gate_table(spark, d):
    o = table(spark, d, "orders")
    return S.gate(o, "orders", F.count(F.lit(1)), 100).unionByName(S.gate(o, "priority", F.avg(F.col("o_orderpriority").isNotNull().cast("double")), 0.99))


@query("leakage_probe", DAILY + """, f AS (SELECT user_id, day, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS w FROM n),
    r AS (SELECT a.user_id, a.day, coalesce(sum(b.n), 0) AS again FROM n a LEFT JOIN n b ON b.user_id = a.user_id AND b.day BETWEEN a.day - 7 AND a.day - 1 GROUP BY 1, 2)
    SELECT CAST(count(*) FILTER (WHERE w <> again) AS INTEGER) AS mismatches, count(*) AS rows FROM f JOIN r USING (user_id, day)""")
def leakage_probe(spark, d):
    """A window of the seven days before, made as a frame and again from raw rows: they must agree everywhere."""
    n = daily(spark, d).withColumn("t", F.unix_date("day"))
    framed = n.withColumn("w", F.coalesce(F.sum("n").over(Window.partitionBy("user_id").orderBy("t").rangeBetween(-7, -1)), F.lit(0)))
    raw = n.select("user_id", F.explode(F.sequence(F.col("t") + 1, F.col("t") + 7)).alias("t"), "n").groupBy("user_id", "t").agg(F.sum("n").alias("again"))
    both = framed.join(raw, ["user_id", "t"], "left")
    return both.agg(F.count_if(F.col("w") != F.coalesce("again", F.lit(0))).cast("int").alias("mismatches"), F.count(F.lit(1)).alias("rows"))


@query("reconcile_tolerance", """WITH a AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS x FROM lineitem GROUP BY 1) SELECT k, abs(x - o_totalprice) > 0.1 * o_totalprice AND abs(x - o_totalprice) > 1000 AS off FROM a JOIN orders ON o_orderkey = k""")
def reconcile_tolerance(spark, d):
    a = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("x"))
    gap = F.abs(F.col("x") - F.col("o_totalprice"))
    return a.join(table(spark, d, "orders"), F.col("k") == F.col("o_orderkey")).select("k", ((gap > 0.1 * F.col("o_totalprice")) & (gap > 1000)).alias("off"))


@query("nonnull_share", "SELECT " + ", ".join(f"avg(CASE WHEN {c} IS NULL THEN 0.0 ELSE 1.0 END) AS {c}" for c in ("event_id", "user_id", "value", "props")) + " FROM events")
def nonnull_share(spark, d):
    return table(spark, d, "events").agg(*(F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in ("event_id", "user_id", "value", "props")))


@query("dup_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_keys(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("signature_ratio", PANEL + " SELECT k, day, round(n / nullif(avg(n) OVER (PARTITION BY k ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), 0), 6) AS ratio FROM p")
def signature_ratio(spark, d):
    base = F.avg("n").over(by().rowsBetween(-14, -1))
    return panel(spark, d).select("k", "day", rnd(F.col("n") / F.nullif(base, F.lit(0.0)), "ratio"))


@query("monotonicity", "SELECT count(*) AS n, count(*) FILTER (WHERE a >= b AND b >= c) AS ok FROM (SELECT l_suppkey, count(*) FILTER (WHERE l_quantity <= 40) AS a, count(*) FILTER (WHERE l_quantity <= 20) AS b, count(*) FILTER (WHERE l_quantity <= 10) AS c FROM lineitem GROUP BY 1)")
def monotonicity(spark, d):
    upto = lambda q, n: F.count_if(F.col("l_quantity") <= q).alias(n)
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(upto(40, "a"), upto(20, "b"), upto(10, "c")).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("a") >= F.col("b")) & (F.col("b") >= F.col("c"))).alias("ok"))


@query("facts_partner_balance", """WITH t AS (SELECT n_name, year(o_orderdate) AS y, sum(l_extendedprice * (1 - l_discount)) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
    r AS (SELECT *, v / sum(v) OVER (PARTITION BY y) AS share, row_number() OVER (PARTITION BY y ORDER BY v DESC, n_name) AS k FROM t) SELECT y, n_name, round(v, 2) AS v, round(share, 8) AS share, k FROM r WHERE k <= 8""")
def facts_partner_balance(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("y"))
    who = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    t = line.join(orders, "o_orderkey").join(who, "c_custkey").groupBy("n_name", "y").agg(F.sum("v").alias("v"))
    w = Window.partitionBy("y")
    r = t.withColumn("share", F.col("v") / F.sum("v").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("v"), "n_name")))
    return r.where("k <= 8").select("y", "n_name", rnd("v", "v", 2), rnd("share", "share", 8), "k")


@query("cover_by_rank", """WITH m AS (SELECT user_id % 40 AS s, date_trunc('hour', ts) AS i, CAST(ts AS DATE) AS d FROM events), t AS (SELECT count(DISTINCT i) AS t FROM m),
    c AS (SELECT s, count(DISTINCT i) AS n, count(DISTINCT d) AS dates FROM m GROUP BY 1),
    r AS (SELECT s, n, dates, n / t AS cover, row_number() OVER (ORDER BY n DESC, dates DESC, s) AS k FROM c, t),
    f AS (SELECT i, min(k) AS k FROM m JOIN r USING (s) WHERE (cover >= 0.02 OR k = 1) AND k <= 12 GROUP BY 1),
    g AS (SELECT r.k, r.s, cover, dates, (SELECT count(*) FROM f WHERE f.k < r.k) / t AS before FROM r, t WHERE (cover >= 0.02 OR r.k = 1) AND r.k <= 12),
    a AS (SELECT s, k AS pick, cover, dates FROM g WHERE before < 0.5),
    b AS (SELECT s, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY dates DESC, n DESC, s) AS pick, cover, dates FROM r WHERE cover >= 0.03 AND s NOT IN (SELECT s FROM a)),
    p AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE pick <= 10),
    h AS (SELECT i, min(pick) AS pick FROM m JOIN p USING (s) GROUP BY 1)
    SELECT pick, s, round(cover, 9) AS cover, dates, round((SELECT count(*) FROM h WHERE h.pick <= p.pick) / t, 9) AS covered FROM p, t""")
def cover_by_rank(spark, d):
    """Groups of users chosen to cover the hours that have events."""
    e = table(spark, d, "events").select((F.col("user_id") % 40).alias("s"), F.date_trunc("hour", "ts").alias("i"), F.to_date("ts").alias("d"))
    return A.cover_sets(e, "s", "i", "d", floor=0.02, target=0.5, cap=12, least=10, near=0.03).select("pick", "s", rnd("cover", "cover", 9), "dates", rnd("covered", "covered", 9))


ROADS = """n AS (SELECT max(c_custkey) AS n FROM customer), e AS (SELECT c_custkey AS u, (c_custkey * (3 + 2 * k) + 11 * k) % n + 1 AS v, CAST(1 + (c_custkey * 7 + k * 5) % 10 AS DOUBLE) AS cost FROM customer, n, range(3) t(k))"""


def roads(spark, d):
    """Three edges from each customer to others, with costs of 1 to 10."""
    c = table(spark, d, "customer").select("c_custkey")
    n = F.broadcast(c.agg(F.max("c_custkey").alias("n")))
    k = F.col("k")
    edges = c.crossJoin(n).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return edges.select(F.col("c_custkey").alias("u"), ((F.col("c_custkey") * (3 + 2 * k) + 11 * k) % F.col("n") + 1).alias("v"), (1.0 + (F.col("c_custkey") * 7 + k * 5) % 10).cast("double").alias("cost"))


@query("travel_times", f"""WITH RECURSIVE {ROADS}, r(source, node, cost) AS (SELECT c_custkey, c_custkey, CAST(0 AS DOUBLE) FROM customer WHERE c_custkey % 50 = 0
    UNION SELECT r.source, e.v, r.cost + e.cost FROM r JOIN e ON e.u = r.node WHERE r.cost + e.cost <= 14) SELECT source, node, CAST(min(cost) AS DOUBLE) AS cost FROM r GROUP BY 1, 2""")
def travel_times(spark, d):
    """All that customers whose key is divisible by 50 reach for at most 14."""
    sources = table(spark, d, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("source"))
    return R.travel_times(roads(spark, d), sources, 14.0)


STOPS = "[s_nationkey, (s_nationkey + 1 + s_suppkey % 5) % 25, (s_nationkey + 9) % 25, (s_nationkey + 13 + s_suppkey % 3) % 25]"
RIDES = f"""trips AS (SELECT s_suppkey AS line, {STOPS} AS stops, 4 + s_suppkey % 7 AS leg, unnest(generate_series(300 + s_suppkey % 60, 1320, 10 + s_suppkey % 50)) AS t FROM supplier),
    rides AS (SELECT line, t, k AS seq, stops[k + 1] AS u, stops[k + 2] AS v, t + k * leg AS departs, t + (k + 1) * leg AS arrives FROM trips, range(3) r(k))"""


def rides(spark, d):
    """Each supplier as a line of four stops (nations), with trips every 10 to 59 minutes."""
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    stops = F.array(n, (n + 1 + s % 5) % 25, (n + 9) % 25, (n + 13 + s % 3) % 25)
    lines = table(spark, d, "supplier").select(s.alias("line"), stops.alias("stops"))
    key = F.col("line")
    return R.schedule(lines, headway=10 + key % 50, first=300 + key % 60, last=F.lit(1320).cast("long"), stops="stops", leg=4 + key % 7)


@query("earliest_arrivals", f"""WITH RECURSIVE {RIDES}, best AS (SELECT DISTINCT u, v, departs, arrives FROM rides WHERE arrives <= 560),
    r(source, node, moment) AS (SELECT n_nationkey, n_nationkey, 480 FROM nation UNION SELECT r.source, b.v, b.arrives FROM r JOIN best b ON b.u = r.node AND b.departs >= r.moment)
    SELECT source, node, min(moment) AS cost FROM r GROUP BY 1, 2""")
def earliest_arrivals(spark, d):
    """When one gets to each nation who sets out from another at 8:00, until 9:20."""
    starts = table(spark, d, "nation").select(F.col("n_nationkey").alias("source"), F.lit(480).alias("at"))
    return R.arrivals(rides(spark, d), starts, latest=560)


@query("schedule_archive", f"WITH {RIDES} SELECT line, count(DISTINCT t) AS trips, count(*) AS rides, min(departs) AS first, max(arrives) AS last FROM rides GROUP BY 1")
def schedule_archive(spark, d):
    """The schedule packed as text members of zip archives, one for every hundred lines, and read back from them."""
    r = rides(spark, d)
    text = F.concat_ws(",", "line", "trip", "seq", "u", "v", "departs", "arrives")
    lines = r.select(F.floor(F.col("line") / 100).cast("string").alias("archive"), F.concat(F.lit("stop_times_"), (F.col("line") % 10).cast("string"), F.lit(".txt")).alias("member"), text.alias("row"))
    path = shared(spark)
    zipped(lines, "archive", "member", "row", "line,trip,seq,u,v,departs,arrives").write.parquet(path)
    back = zip_csv(spark.read.parquet(path), r"stop_times_\d\.txt", "line long, trip int, seq int, u int, v int, departs long, arrives long")
    trips = F.count_distinct("trip").alias("trips")
    return back.groupBy("line").agg(trips, F.count(F.lit(1)).alias("rides"), F.min("departs").alias("first"), F.max("arrives").alias("last"))


@query("scan_npz", """WITH c AS (SELECT event_type AS name, dayofmonth(ts) - 1 AS i, hour(ts) AS j, sum(value) AS v FROM events GROUP BY 1, 2, 3)
    SELECT name, i, j, round(round(v * 100) / 100, 6) AS value FROM c WHERE i BETWEEN 3 AND 9 AND j < 12""")
def scan_npz(spark, d):
    """Sums by day and hour as one dense array of hundredths for each event type, of which a window is read back."""
    cells = table(spark, d, "events").groupBy(F.col("event_type").alias("name"), (F.dayofmonth("ts") - 1).alias("i"), F.hour("ts").alias("j")).agg(F.sum("value").alias("v"))
    path = shared(spark)
    packed_arrays(cells, "name", "i", "j", "v", shape=(31, 24), scale=0.01).write.parquet(path)
    return array_window(spark.read.parquet(path), "name", rows=(3, 10), columns=(0, 12)).select("name", "i", "j", rnd("value", "value"))
