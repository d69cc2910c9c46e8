"""Queries of aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..sources.tables import table
from .registry import query


def rows():
    return F.count(F.lit(1))


@query("agg_group_sum", "SELECT year(l_shipdate) AS y, substr(l_returnflag, 1, 1) AS f, round(sum(l_quantity), 2) AS q, count(*) AS n, round(avg(l_discount), 6) AS a, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY 1, 2")
def agg_group_sum(spark, d):
    return table(spark, d, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("y"), F.substring("l_returnflag", 1, 1).alias("f")).agg(
        F.round(F.sum("l_quantity"), 2).alias("q"), rows().alias("n"), F.round(F.avg("l_discount"), 6).alias("a"), F.min("l_tax").alias("lo"), F.max("l_tax").alias("hi")
    )


@query("agg_global", "SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi, count(DISTINCT o_custkey) AS c, count(*) AS n FROM orders")
def agg_global(spark, d):
    return table(spark, d, "orders").agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"), F.count_distinct("o_custkey").alias("c"), rows().alias("n"))


@query("agg_count_distinct", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def agg_count_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"))


@query("agg_filter", """SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT user_id) FILTER (WHERE event_type = 'click') AS clickers,
    round(sum(value) FILTER (WHERE event_type = 'purchase'), 4) AS bought FROM events GROUP BY 1""")
def agg_filter(spark, d):
    kind = lambda k: F.col("event_type") == k
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(
        rows().alias("n"), F.count_if(kind("error")).alias("errors"), F.count_distinct(F.when(kind("click"), F.col("user_id"))).alias("clickers"), F.round(F.sum(F.when(kind("purchase"), F.col("value"))), 4).alias("bought")
    )


@query("agg_conditional_sum", "SELECT o_custkey, round(sum(CASE WHEN year(o_orderdate) IN (1996, 1997, 1998) THEN o_totalprice ELSE 0 END) / 3, 4) AS base FROM orders GROUP BY 1")
def agg_conditional_sum(spark, d):
    base = F.sum(F.when(F.year("o_orderdate").isin(1996, 1997, 1998), F.col("o_totalprice")).otherwise(0.0)) / 3
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.round(base, 4).alias("base"))


@query("agg_weighted_mean", "SELECT l_suppkey, round(sum(l_discount * l_quantity) / nullif(sum(l_quantity), 0), 8) AS m FROM lineitem GROUP BY 1")
def agg_weighted_mean(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(A.weighted_mean("l_discount", "l_quantity"), 8).alias("m"))


@query("agg_any_value", "SELECT n_regionkey, any_value(r_name) AS r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def agg_any_value(spark, d):
    return table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_regionkey").agg(F.any_value("r_name", True).alias("r_name"), rows().alias("n"))


@query("agg_mode", """WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS k FROM c)
    SELECT c_nationkey, c_mktsegment AS mode FROM r WHERE k = 1""")
def agg_mode(spark, d):
    return A.mode_smallest(table(spark, d, "customer"), ["c_nationkey"], "c_mktsegment")


@query("agg_string_ordered", """WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)
    SELECT c_nationkey, string_agg(c_mktsegment || ':' || n, ',' ORDER BY n DESC, c_mktsegment) AS s FROM c GROUP BY 1""")
def agg_string_ordered(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(rows().alias("n"))
    listed = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "c_mktsegment", "n")))
    return c.groupBy("c_nationkey").agg(F.array_join(F.transform(listed, lambda x: F.concat(x["c_mktsegment"], F.lit(":"), x["n"].cast("string"))), ",").alias("s"))


@query("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15")
def agg_having(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(rows().alias("n")).where("n >= 15")


@query("agg_completeness", "SELECT c_custkey, count(*) AS size, count(o_orderkey) AS obs, count(o_orderkey) / count(*) AS share FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def agg_completeness(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.groupBy("c_custkey").agg(rows().alias("size"), F.count("o_orderkey").alias("obs"), (F.count("o_orderkey") / rows()).alias("share"))


@query("agg_quantiles", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.1) AS p10, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.9) AS p90 FROM lineitem GROUP BY 1")
def agg_quantiles(spark, d):
    q = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_extendedprice", [0.1, 0.5, 0.9]).alias("q"))
    return q.select("l_returnflag", *(F.col("q")[k].alias(n) for k, n in enumerate(("p10", "p50", "p90"))))


@query("agg_median", "SELECT c_nationkey, median(c_acctbal) AS m FROM customer GROUP BY 1")
def agg_median(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.median("c_acctbal").alias("m"))


@query("agg_median_upper", """WITH r AS (SELECT c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
    SELECT c_nationkey, c_acctbal AS median FROM r WHERE k = n // 2 + 1""")
def agg_median_upper(spark, d):
    return A.upper_median(table(spark, d, "customer"), ["c_nationkey"], "c_acctbal")


@query("agg_stddev", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS s, round(stddev_pop(l_quantity), 6) AS p, round(var_samp(l_quantity), 6) AS v FROM lineitem GROUP BY 1")
def agg_stddev(spark, d):
    r = lambda f, n: F.round(f("l_quantity"), 6).alias(n)
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r(F.stddev_samp, "s"), r(F.stddev_pop, "p"), r(F.var_samp, "v"))


@query("agg_corr", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def agg_corr(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@query("agg_spearman", """WITH r AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2 AS x,
        rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2 AS y FROM lineitem)
    SELECT l_suppkey, round(corr(x, y), 6) AS spearman FROM r GROUP BY 1""")
def agg_spearman(spark, d):
    return A.spearman(table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice"), ["l_suppkey"], "l_quantity", "l_extendedprice").withColumn("spearman", F.round("spearman", 6))


@query("agg_argmax", """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, day) AS k FROM d) SELECT user_id, day FROM r WHERE k = 1""")
def agg_argmax(spark, d):
    days = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(rows().alias("n"))
    return days.groupBy("user_id").agg(F.max_by("day", F.struct("n", -F.unix_date("day"))).alias("day"))


@query("agg_sum_min_count", "SELECT c_nationkey, round(sum(CASE WHEN c_acctbal > 9900 THEN c_acctbal END), 2) AS strict, round(coalesce(sum(CASE WHEN c_acctbal > 9900 THEN c_acctbal END), 0), 2) AS lax FROM customer GROUP BY 1")
def agg_sum_min_count(spark, d):
    s = F.sum(F.when(F.col("c_acctbal") > 9900, F.col("c_acctbal")))
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(s, 2).alias("strict"), F.round(F.coalesce(s, F.lit(0.0)), 2).alias("lax"))


@query("agg_multi_named", """SELECT l_suppkey, max(l_quantity) AS q_max, min(l_quantity) AS q_min, round(avg(l_quantity), 6) AS q_mean, round(sum(l_extendedprice), 2) AS price, count(*) AS n,
    count(DISTINCT l_orderkey) AS orders, max(l_shipdate) AS last, min(l_shipdate) AS first FROM lineitem GROUP BY 1""")
def agg_multi_named(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.max("l_quantity").alias("q_max"), F.min("l_quantity").alias("q_min"), F.round(F.avg("l_quantity"), 6).alias("q_mean"), F.round(F.sum("l_extendedprice"), 2).alias("price"), rows().alias("n"),
        F.count_distinct("l_orderkey").alias("orders"), F.max("l_shipdate").alias("last"), F.min("l_shipdate").alias("first"),
    )


@query("agg_share_above", "SELECT l_suppkey, avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END) AS share, count(*) FILTER (WHERE l_discount > 0.08) AS n FROM lineitem GROUP BY 1")
def agg_share_above(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg((F.col("l_discount") > 0.05).cast("double")).alias("share"), F.count_if(F.col("l_discount") > 0.08).alias("n"))


@query("agg_min_obs", "SELECT user_id, round(avg(value), 6) AS m FROM events GROUP BY 1 HAVING count(*) >= 60")
def agg_min_obs(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(rows().alias("n"), F.round(F.avg("value"), 6).alias("m")).where("n >= 60").drop("n")


@query("agg_two_phase", "SELECT l_suppkey, round(sum(l_quantity), 2) AS q, count(*) AS n FROM lineitem GROUP BY 1")
def agg_two_phase(spark, d):
    parts = table(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("part")).agg(F.sum("l_quantity").alias("q"), rows().alias("n"))
    return parts.groupBy("l_suppkey").agg(F.round(F.sum("q"), 2).alias("q"), F.sum("n").alias("n"))


@query("agg_weighted_centroid", "SELECT c_nationkey, round(sum(c_acctbal * abs(c_acctbal)) / sum(abs(c_acctbal)), 4) AS x FROM customer GROUP BY 1")
def agg_weighted_centroid(spark, d):
    w = F.abs("c_acctbal")
    parts = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.sum(F.col("c_acctbal") * w).alias("xw"), F.sum(w).alias("w"))
    return parts.groupBy("c_nationkey").agg(F.round(F.sum("xw") / F.sum("w"), 4).alias("x"))


@query("zonal_sum", "SELECT n_regionkey AS zone, count(*) AS n, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 6) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def zonal_sum(spark, d):
    zones = F.broadcast(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("zone")))
    return table(spark, d, "customer").join(zones, "c_nationkey").groupBy("zone").agg(rows().alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.round(F.avg("c_acctbal"), 6).alias("mean"))


@query("grid_aggregate", "SELECT floor(p_retailprice / 100) * 100 AS x, floor(p_size / 10) * 10 AS y, count(*) AS n, round(avg(p_retailprice), 6) AS m FROM part GROUP BY 1, 2")
def grid_aggregate(spark, d):
    x, y = F.floor(F.col("p_retailprice") / 100) * 100.0, F.floor(F.col("p_size") / 10) * 10.0
    return table(spark, d, "part").groupBy(x.alias("x"), y.alias("y")).agg(rows().alias("n"), F.round(F.avg("p_retailprice"), 6).alias("m"))


EDGES = (0, 1000, 2500, 5000, 7500)


@query("agg_histogram", "SELECT CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 1000 THEN 1 WHEN c_acctbal < 2500 THEN 2 WHEN c_acctbal < 5000 THEN 3 WHEN c_acctbal < 7500 THEN 4 ELSE 5 END AS bin, count(*) AS n FROM customer GROUP BY 1")
def agg_histogram(spark, d):
    bins = sum(((F.col("c_acctbal") >= e).cast("int") for e in EDGES), F.lit(0))
    return table(spark, d, "customer").groupBy(bins.alias("bin")).agg(rows().alias("n"))


@query("hist_quantile", """WITH h AS (SELECT CAST(floor(l_extendedprice / 5000) AS BIGINT) AS b, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT b, n, sum(n) OVER (ORDER BY b) AS upto, sum(n) OVER () AS whole FROM h)
    SELECT round((b + (whole * 0.9 - (upto - n)) / n) * 5000, 6) AS p90 FROM c WHERE upto >= whole * 0.9 AND upto - n < whole * 0.9""")
def hist_quantile(spark, d):
    h = table(spark, d, "lineitem").groupBy(F.floor(F.col("l_extendedprice") / 5000).alias("b")).agg(rows().alias("n"))
    # the windows run over the bins, a number that does not grow with the rows
    c = h.withColumn("upto", F.sum("n").over(Window.orderBy("b"))).withColumn("goal", F.sum("n").over(Window.partitionBy()) * 0.9)
    hit = c.where((F.col("upto") >= F.col("goal")) & (F.col("upto") - F.col("n") < F.col("goal")))
    return hit.select(F.round((F.col("b") + (F.col("goal") - (F.col("upto") - F.col("n"))) / F.col("n")) * 5000, 6).alias("p90"))


@query("agg_hhi", "WITH s AS (SELECT c_nationkey, c_mktsegment, sum(abs(c_acctbal)) AS v FROM customer GROUP BY 1, 2), t AS (SELECT *, v / sum(v) OVER (PARTITION BY c_nationkey) AS s FROM s) SELECT c_nationkey, round(sum(s * s), 8) AS hhi FROM t GROUP BY 1")
def agg_hhi(spark, d):
    c = table(spark, d, "customer").withColumn("v", F.abs("c_acctbal"))
    return A.hhi(c, ["c_nationkey"], "c_mktsegment", "v").withColumn("hhi", F.round("hhi", 8))


@query("agg_topn_share", """WITH s AS (SELECT l_returnflag, l_suppkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2), r AS (SELECT *, v / sum(v) OVER (PARTITION BY l_returnflag) AS s, row_number() OVER (PARTITION BY l_returnflag ORDER BY v DESC, l_suppkey) AS k FROM s)
    SELECT l_returnflag, round(sum(s), 8) AS top_share FROM r WHERE k <= 5 GROUP BY 1""")
def agg_topn_share(spark, d):
    return A.topn_share(table(spark, d, "lineitem"), ["l_returnflag"], "l_suppkey", "l_extendedprice", 5).withColumn("top_share", F.round("top_share", 8))


@query("pivot_sum", "SELECT l_suppkey, " + ", ".join(f"round(coalesce(sum(CASE WHEN l_returnflag = '{f}' THEN l_quantity END), 0), 2) AS {f.lower()}" for f in "ANR") + " FROM lineitem GROUP BY 1")
def pivot_sum(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    return p.select("l_suppkey", *(F.round(F.coalesce(f, F.lit(0.0)), 2).alias(f.lower()) for f in "ANR"))


@query("pivot_count", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def pivot_count(spark, d):
    p = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    return p.withColumnsRenamed({c: c.lower() for c in "FOP"})


@query("unpivot", "UNPIVOT (SELECT s_suppkey, s_acctbal, CAST(s_nationkey AS DOUBLE) AS nation FROM supplier) ON s_acctbal, nation INTO NAME name VALUE value")
def unpivot(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("nation"))
    return s.unpivot(["s_suppkey"], ["s_acctbal", "nation"], "name", "value")


@query("group_transform", "SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey), 6) AS apart FROM customer")
def group_transform(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(F.col("c_acctbal") - F.avg("c_acctbal").over(Window.partitionBy("c_nationkey")), 6).alias("apart"))


@query("agg_first_nonnull", "SELECT user_id, arg_min(CASE WHEN event_type = 'click' THEN value END, ts) AS first_click, arg_min(CASE WHEN event_type = 'error' THEN value END, ts) AS first_error FROM events GROUP BY 1")
def agg_first_nonnull(spark, d):
    first = lambda kind: F.min_by(F.when(F.col("event_type") == kind, F.col("value")), F.when((F.col("event_type") == kind) & F.col("value").isNotNull(), F.col("ts")))
    return table(spark, d, "events").groupBy("user_id").agg(first("click").alias("first_click"), first("error").alias("first_error"))


@query("dedupe_priority", "SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def dedupe_priority(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    return A.dedupe(o, ["o_custkey"], [F.col("o_orderpriority"), F.desc("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query("balanced_panel", "WITH y AS (SELECT o_custkey, count(DISTINCT year(o_orderdate)) AS n FROM orders GROUP BY 1) SELECT o_custkey FROM y WHERE n = (SELECT count(DISTINCT year(o_orderdate)) FROM orders)")
def balanced_panel(spark, d):
    y = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y"))
    whole = y.agg(F.count_distinct("y").alias("whole"))
    return y.groupBy("o_custkey").agg(F.count_distinct("y").alias("n")).join(F.broadcast(whole), F.col("n") == F.col("whole")).select("o_custkey")


@query("apply_in_pandas", "SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY 1")
def apply_in_pandas(spark, d):
    """A frame function a group, given each group's sums and not its rows: a group of any size is one row."""

    def slope(pdf):
        sxx, sxy = pdf["xx"] - pdf["x"] ** 2 / pdf["n"], pdf["xy"] - pdf["x"] * pdf["y"] / pdf["n"]
        return pdf[["l_suppkey"]].assign(slope=(sxy / sxx.where(sxx > 0)).round(4))

    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    sums = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"))
    return sums.groupBy("l_suppkey").applyInPandas(slope, "l_suppkey long, slope double")


@query("weighted_median", """WITH r AS (SELECT c_nationkey, c_acctbal, sum(c_custkey + 1) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey ROWS UNBOUNDED PRECEDING) / sum(c_custkey + 1) OVER (PARTITION BY c_nationkey) AS w FROM customer)
    SELECT c_nationkey, min(c_acctbal) AS weighted_median FROM r WHERE w >= 0.5 GROUP BY 1""")
def weighted_median(spark, d):
    c = table(spark, d, "customer").withColumn("w", F.col("c_custkey") + 1)
    return A.weighted_median(c, ["c_nationkey"], "c_acctbal", "w", "c_custkey")


LORENZ = """r AS (SELECT n_regionkey AS g, o_totalprice AS v, sum(1.0) OVER w / count(*) OVER (PARTITION BY n_regionkey) AS cw, sum(o_totalprice) OVER w / sum(o_totalprice) OVER (PARTITION BY n_regionkey) AS cv, o_orderkey
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WINDOW w AS (PARTITION BY n_regionkey ORDER BY o_totalprice, o_orderkey ROWS UNBOUNDED PRECEDING))"""


def order_values(spark, d):
    nations = F.broadcast(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("g")))
    who = table(spark, d, "customer").join(nations, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "g")
    return table(spark, d, "orders").join(who, "o_custkey").select("g", F.col("o_totalprice").alias("v"), F.lit(1.0).alias("w"), "o_orderkey")


@query("gini", f"WITH {LORENZ}, p AS (SELECT g, cw - coalesce(lag(cw) OVER x, 0) AS dw, cv + coalesce(lag(cv) OVER x, 0) AS sv FROM r WINDOW x AS (PARTITION BY g ORDER BY v, o_orderkey)) SELECT g, round(1 - sum(dw * sv), 8) AS gini FROM p GROUP BY 1")
def gini(spark, d):
    return A.gini(order_values(spark, d), ["g"], "v", "w", "o_orderkey").withColumn("gini", F.round("gini", 8))


@query("lorenz_curve", f"WITH {LORENZ} SELECT g, CAST(ceil(round(cw * 10, 9)) AS BIGINT) AS decile, round(max(cv), 8) AS share FROM r GROUP BY 1, 2")
def lorenz_curve(spark, d):
    r = A.ranked_weights(order_values(spark, d), ["g"], "v", "w", "o_orderkey")
    return r.groupBy("g", F.ceil(F.round(F.col("cum_weight") * 10, 9)).cast("long").alias("decile")).agg(F.round(F.max("cum_value"), 8).alias("share"))


@query("palma", f"WITH {LORENZ} SELECT g, round((1 - max(CASE WHEN cw <= 0.9 THEN cv END)) / max(CASE WHEN cw <= 0.4 THEN cv END), 8) AS palma FROM r GROUP BY 1")
def palma(spark, d):
    r = A.ranked_weights(order_values(spark, d), ["g"], "v", "w", "o_orderkey")
    upto = lambda q: F.max(F.when(F.col("cum_weight") <= q, F.col("cum_value")))
    return r.groupBy("g").agg(F.round((1 - upto(0.9)) / upto(0.4), 8).alias("palma"))


@query("concentration_index", """WITH r AS (SELECT c_nationkey AS g, abs(c_acctbal) AS v, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 0.5) / count(*) OVER (PARTITION BY c_nationkey) AS r FROM customer)
    SELECT g, round(2 * (avg(v * r) - avg(v) * avg(r)) / avg(v), 8) AS ci FROM r GROUP BY 1""")
def concentration_index(spark, d):
    whole = Window.partitionBy("g")
    r = table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), F.abs("c_acctbal").alias("v"), "c_custkey")
    r = r.withColumn("r", (F.row_number().over(whole.orderBy("c_custkey")) - 0.5) / F.count(F.lit(1)).over(whole))
    return r.groupBy("g").agg(F.round(2 * (F.avg(F.col("v") * F.col("r")) - F.avg("v") * F.avg("r")) / F.avg("v"), 8).alias("ci"))


@query("cumulative_cutoff", "SELECT s_suppkey, cut, coalesce(CAST(sum(CASE WHEN l_quantity <= cut THEN 1 ELSE 0 END) AS BIGINT), 0) AS reached FROM supplier CROSS JOIN (VALUES (10), (20), (30)) c(cut) LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2")
def cumulative_cutoff(spark, d):
    sums = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(*(F.count_if(F.col("l_quantity") <= c).alias(str(c)) for c in (10, 20, 30)))
    wide = table(spark, d, "supplier").select("s_suppkey").join(sums, "s_suppkey", "left").fillna(0)
    return wide.select("s_suppkey", F.inline(F.array(*(F.struct(F.lit(c).alias("cut"), F.col(str(c)).alias("reached")) for c in (10, 20, 30)))))


@query("decay_sum", "SELECT l_suppkey, round(sum(exp(-0.05 * l_quantity) * l_tax), 8) AS g, min(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS nearest FROM lineitem GROUP BY 1")
def decay_sum(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(F.exp(-0.05 * F.col("l_quantity")) * F.col("l_tax")), 8).alias("g"), F.min(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("nearest"))


def levels(spark, d):
    return table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))


for name, words in (("rollup_levels", "ROLLUP (n_regionkey, c_nationkey)"), ("cube", "CUBE (n_regionkey, c_mktsegment)"), ("grouping_sets", "GROUPING SETS ((n_regionkey), (c_mktsegment), ())")):
    keys = [k for k in ("n_regionkey", "c_nationkey", "c_mktsegment") if k in words]

    def grouped(spark, d, name=name, keys=keys):
        df, n, v = levels(spark, d), rows().alias("n"), F.round(F.sum("c_acctbal"), 2).alias("v")
        if name == "rollup_levels":
            return df.rollup(*keys).agg(n, v)
        if name == "cube":
            return df.cube(*keys).agg(n, v)
        return df.groupingSets([["n_regionkey"], ["c_mktsegment"], []], *keys).agg(n, v)

    query(name, f"SELECT {', '.join(keys)}, count(*) AS n, round(sum(c_acctbal), 2) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY {words}")(grouped)


@query("entry_exit_counts", """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1997), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1998)
    SELECT count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS n_common, count(*) FILTER (WHERE a.k IS NULL) AS n_entry, count(*) FILTER (WHERE b.k IS NULL) AS n_exit FROM a FULL JOIN b ON a.k = b.k""")
def entry_exit_counts(spark, d):
    o = table(spark, d, "orders").where(F.year("o_orderdate").isin(1997, 1998)).groupBy("o_custkey").agg(F.bool_or(F.year("o_orderdate") == 1997).alias("a"), F.bool_or(F.year("o_orderdate") == 1998).alias("b"))
    return o.agg(F.count_if(F.col("a") & F.col("b")).alias("n_common"), F.count_if(~F.col("a")).alias("n_entry"), F.count_if(~F.col("b")).alias("n_exit"))


@query("separable_extremes", """WITH s AS (SELECT n_regionkey AS g, c_nationkey AS u, avg(c_acctbal) AS m, stddev_samp(c_acctbal) / sqrt(count(*)) AS e FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY m DESC, u) AS hi, row_number() OVER (PARTITION BY g ORDER BY m, u) AS lo FROM s)
    SELECT a.g, a.u AS top, b.u AS low, a.m - 1.96 * a.e > b.m + 1.96 * b.e AS apart FROM r a JOIN r b ON a.g = b.g AND a.hi = 1 AND b.lo = 1""")
def separable_extremes(spark, d):
    s = levels(spark, d).groupBy(F.col("n_regionkey").alias("g"), F.col("c_nationkey").alias("u")).agg(F.avg("c_acctbal").alias("m"), (F.stddev_samp("c_acctbal") / F.sqrt(rows())).alias("e"))
    both = s.groupBy("g").agg(F.max_by(F.struct("u", "m", "e"), F.struct("m", -F.col("u"))).alias("a"), F.min_by(F.struct("u", "m", "e"), F.struct("m", "u")).alias("b"))
    return both.select("g", F.col("a.u").alias("top"), F.col("b.u").alias("low"), (F.col("a.m") - 1.96 * F.col("a.e") > F.col("b.m") + 1.96 * F.col("b.e")).alias("apart"))


@query("agg_ordered_arrays", """SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS ids, string_agg(event_type, ',' ORDER BY ts, event_id) AS kinds FROM events WHERE value > 40 GROUP BY 1""")
def agg_ordered_arrays(spark, d):
    rows = table(spark, d, "events").where("value > 40").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("r"))
    joined = lambda f: F.array_join(F.transform("r", lambda x: x[f].cast("string")), ",")
    return rows.select("user_id", joined("event_id").alias("ids"), joined("event_type").alias("kinds"))


@query("dense_vector_u8", """WITH n AS (SELECT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS i, count(*) AS c FROM events GROUP BY 1, 2), m AS (SELECT max(c) AS m FROM n),
    s AS (SELECT u.user_id, i.i, coalesce(n.c, 0) AS c FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(0, 30)) AS i) i LEFT JOIN n ON n.user_id = u.user_id AND n.i = i.i)
    SELECT user_id, string_agg(CAST(CAST(round_even(c / m * 255, 0) AS INTEGER) AS VARCHAR), ',' ORDER BY i) AS v FROM s CROSS JOIN m GROUP BY 1""")
def dense_vector_u8(spark, d):
    n = table(spark, d, "events").groupBy("user_id", F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))).alias("i")).agg(rows().alias("c"))
    top = F.broadcast(n.agg(F.max("c").alias("m")))
    at = n.crossJoin(top).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("i", F.bround(F.col("c") / F.col("m") * 255, 0).cast("int")))).alias("at"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.coalesce(F.try_element_at("at", i), F.lit(0)).cast("string"))
    return at.select("user_id", F.array_join(dense, ",").alias("v"))


@query("agg_share", "SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS share FROM lineitem GROUP BY 1")
def agg_share(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg((F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)) / F.sum("l_quantity")).alias("share"))


@query("expected_vs_observed", """WITH n AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS v FROM orders GROUP BY 1), r AS (SELECT day, isodow(day) >= 6 AS weekend, row_number() OVER (ORDER BY v DESC, day) AS k FROM n)
    SELECT count(*) FILTER (WHERE k <= 30 AND weekend) AS observed, 30.0 * count(*) FILTER (WHERE weekend) / count(*) AS expected FROM r""")
def expected_vs_observed(spark, d):
    n = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("v"))
    weekend = F.weekday("day") >= 5
    top = n.orderBy(F.desc("v"), "day").limit(30).agg(F.count_if(weekend).alias("observed"))
    return n.agg((30.0 * F.count_if(weekend) / rows()).alias("expected")).crossJoin(F.broadcast(top)).select("observed", "expected")


@query("group_ratio_extremes", """WITH m AS (SELECT l_suppkey, month(l_shipdate) AS m, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), r AS (SELECT l_suppkey, max(q) / nullif(min(q), 0) AS r FROM m GROUP BY 1)
    SELECT round(avg(r), 6) AS mean, round(max(r), 6) AS top, arg_max(l_suppkey, r) AS who FROM r""")
def group_ratio_extremes(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_suppkey", F.month("l_shipdate").alias("m")).agg(F.sum("l_quantity").alias("q"))
    r = m.groupBy("l_suppkey").agg((F.max("q") / F.nullif(F.min("q"), F.lit(0.0))).alias("r"))
    return r.agg(F.round(F.avg("r"), 6).alias("mean"), F.round(F.max("r"), 6).alias("top"), F.max_by("l_suppkey", "r").alias("who"))


@query("value_counts", "SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def value_counts(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(rows().alias("n"))
