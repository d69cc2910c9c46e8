"""Queries of window functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows as W
from ..operators.aggregates import average_rank, dealt
from ..operators.joins import densify
from ..sources.tables import table
from .registry import query

DAILY = "WITH n AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)"
#: A dense daily panel of event types: one row a type and day.
PANEL = """WITH n AS (SELECT event_type AS k, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2),
    p AS (SELECT t.k, s.day, n.n AS raw, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT k FROM n) t CROSS JOIN (SELECT CAST(unnest(generate_series((SELECT min(day) FROM n), (SELECT max(day) FROM n), INTERVAL 1 DAY)) AS DATE) AS day) s
        LEFT JOIN n ON n.k = t.k AND n.day = s.day)"""
SPARSE = PANEL.replace("coalesce(n.n, 0) AS n", "CASE WHEN day(s.day) % 3 <> 0 THEN n.n END AS x, coalesce(n.n, 0) AS n")


def daily(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def panel(spark, d):
    n = table(spark, d, "events").groupBy(F.col("event_type").alias("k"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return densify(n, ["k"], "day").fillna(0, ["n"])


def sparse(spark, d):
    return panel(spark, d).withColumn("x", F.when((F.dayofmonth("day") % 3 != 0) & (F.col("n") > 0), F.col("n")))


def by(key="k", order="day"):
    return Window.partitionBy(key).orderBy(order)


@query("win_rank", "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS r FROM customer")
def win_rank(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.rank().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"))).alias("r"))


@query("win_count", "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer")
def win_count(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.count(F.lit(1)).over(Window.partitionBy("c_nationkey")).alias("n"))


@query("win_topn_group", "SELECT * FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 5")
def win_topn_group(spark, d):
    r = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return table(spark, d, "customer").select("c_nationkey", "c_custkey", r.alias("r")).where("r <= 5")


@query("win_lagged_frames", PANEL + """ SELECT k, day, CAST(sum(n) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS BIGINT) AS s7, avg(n) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS a14 FROM p WINDOW w AS (PARTITION BY k ORDER BY day)""")
def win_lagged_frames(spark, d):
    return panel(spark, d).select("k", "day", F.sum("n").over(by().rowsBetween(-7, -1)).alias("s7"), F.avg("n").over(by().rowsBetween(-14, -1)).alias("a14"))


@query("win_forward_frame", PANEL + " SELECT k, day, CAST(sum(n) OVER (PARTITION BY k ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS BIGINT) AS next7 FROM p")
def win_forward_frame(spark, d):
    return panel(spark, d).select("k", "day", F.sum("n").over(by().rowsBetween(1, 7)).alias("next7"))


@query("win_lead", PANEL + " SELECT k, day, lead(n, 1) OVER w AS l1, lead(n, 3) OVER w AS l3, lead(n, 7) OVER w AS l7 FROM p WINDOW w AS (PARTITION BY k ORDER BY day)")
def win_lead(spark, d):
    return panel(spark, d).select("k", "day", *(F.lead("n", h).over(by()).alias(f"l{h}") for h in (1, 3, 7)))


@query("win_named", PANEL + """ SELECT k, day, row_number() OVER w AS r, CAST(sum(n) OVER w AS BIGINT) AS upto, max(n) OVER w AS top, first_value(n) OVER w AS first FROM p WINDOW w AS (PARTITION BY k ORDER BY day ROWS UNBOUNDED PRECEDING)""")
def win_named(spark, d):
    panel(spark, d).createOrReplaceTempView("daily_panel")
    return spark.sql("SELECT k, day, row_number() OVER o AS r, sum(n) OVER w AS upto, max(n) OVER w AS top, first_value(n) OVER w AS first FROM daily_panel WINDOW o AS (PARTITION BY k ORDER BY day), w AS (PARTITION BY k ORDER BY day ROWS UNBOUNDED PRECEDING)")


@query("win_lag", PANEL + " SELECT k, day, lag(n, 1) OVER w AS b1, lag(n, 2) OVER w AS b2, lag(n, 6) OVER w AS b6 FROM p WINDOW w AS (PARTITION BY k ORDER BY day)")
def win_lag(spark, d):
    return panel(spark, d).select("k", "day", *(F.lag("n", h).over(by()).alias(f"b{h}") for h in (1, 2, 6)))


@query("win_min_periods", SPARSE + """ SELECT k, day, CASE WHEN count(x) OVER w >= 4 THEN avg(x) OVER w END AS m, CASE WHEN count(x) OVER w >= 4 THEN round(stddev_samp(x) OVER w, 6) END AS s FROM p
    WINDOW w AS (PARTITION BY k ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def win_min_periods(spark, d):
    return sparse(spark, d).select("k", "day", W.rolling(F.avg, "x", by(), -6, 0, 4).alias("m"), F.round(W.rolling(F.stddev_samp, "x", by(), -6, 0, 4), 6).alias("s"))


@query("win_centered", SPARSE + " SELECT k, day, CASE WHEN count(x) OVER w >= 3 THEN avg(x) OVER w END AS m FROM p WINDOW w AS (PARTITION BY k ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def win_centered(spark, d):
    return sparse(spark, d).select("k", "day", W.rolling(F.avg, "x", by(), -3, 3, 3).alias("m"))


@query("win_trailing_excl", SPARSE + " SELECT k, day, CASE WHEN count(x) OVER w >= 7 THEN avg(x) OVER w END AS base FROM p WINDOW w AS (PARTITION BY k ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)")
def win_trailing_excl(spark, d):
    return sparse(spark, d).select("k", "day", W.rolling(F.avg, "x", by(), -14, -1, 7).alias("base"))


@query("win_range_interval", DAILY + " SELECT user_id, day, avg(n) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS base FROM n")
def win_range_interval(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.unix_date("day")).rangeBetween(-14, -1)
    return daily(spark, d).select("user_id", "day", F.avg("n").over(w).alias("base"))


@query("win_diff", PANEL + " SELECT k, day, n - lag(n) OVER (PARTITION BY k ORDER BY day) AS diff FROM p")
def win_diff(spark, d):
    return panel(spark, d).select("k", "day", (F.col("n") - F.lag("n").over(by())).alias("diff"))


@query("win_yoy_log", PANEL + ", r AS (SELECT k, day, sum(n) OVER (PARTITION BY k ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM p) SELECT k, day, CASE WHEN s > 0 AND b > 0 THEN round(ln(s / b), 9) END AS g FROM (SELECT *, lag(s, 12) OVER (PARTITION BY k ORDER BY day) AS b FROM r)")
def win_yoy_log(spark, d):
    r = panel(spark, d).withColumn("s", F.sum("n").over(by().rowsBetween(-2, 0))).withColumn("b", F.lag("s", 12).over(by()))
    return r.select("k", "day", F.when((F.col("s") > 0) & (F.col("b") > 0), F.round(F.log(F.col("s") / F.col("b")), 9)).alias("g"))


@query("win_cumulative", PANEL + " SELECT k, day, CAST(sum(n) OVER w AS BIGINT) AS upto, sum(n) OVER w / sum(n) OVER (PARTITION BY k) AS share FROM p WINDOW w AS (PARTITION BY k ORDER BY day ROWS UNBOUNDED PRECEDING)")
def win_cumulative(spark, d):
    upto = F.sum("n").over(by().rowsBetween(Window.unboundedPreceding, 0))
    return panel(spark, d).select("k", "day", upto.alias("upto"), (upto / F.sum("n").over(Window.partitionBy("k"))).alias("share"))


RUNS = PANEL + """, f AS (SELECT k, day, n, n > (SELECT avg(n) FROM p) AS wet FROM p), g AS (SELECT *, sum(CASE WHEN wet THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY day) AS g FROM f)
    SELECT k, day, row_number() OVER (PARTITION BY k, g ORDER BY day) - CASE WHEN g > 0 THEN 1 ELSE 0 END AS run FROM g"""


@query("win_run_length", RUNS)
def win_run_length(spark, d):
    p = panel(spark, d)
    flagged = p.crossJoin(F.broadcast(p.agg(F.avg("n").alias("m")))).withColumn("wet", F.col("n") > F.col("m"))
    return W.run_lengths(flagged, ["k"], "day", F.col("wet")).select("k", "day", "run")


@query("win_islands", DAILY + ", s AS (SELECT *, CASE WHEN date_diff('day', lag(day) OVER (PARTITION BY user_id ORDER BY day), day) <= 2 THEN 0 ELSE 1 END AS s FROM n), i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY day) AS island FROM s) SELECT user_id, CAST(island AS BIGINT) AS island, min(day) AS first, max(day) AS last, CAST(sum(n) AS BIGINT) AS n FROM i GROUP BY 1, 2")
def win_islands(spark, d):
    days = daily(spark, d).withColumn("t", F.unix_date("day"))
    return W.islands(days, ["user_id"], "t", 2).groupBy("user_id", "island").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.sum("n").alias("n"))


@query("win_cumcount", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events")
def win_cumcount(spark, d):
    return table(spark, d, "events").select("event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("i"))


@query("win_percent_rank", "SELECT c_custkey, percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS p, cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS q FROM customer")
def win_percent_rank(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.percent_rank().over(w).alias("p"), F.cume_dist().over(w).alias("q"))


@query("win_avg_rank", "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2 AS r FROM lineitem")
def win_avg_rank(spark, d):
    rows = dealt(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"), ["l_suppkey"])
    return rows.select("l_orderkey", "l_linenumber", average_rank("l_quantity", ["l_suppkey"]).alias("r"))


@query("win_qcut", """WITH q AS (SELECT c_nationkey, quantile_cont(c_acctbal, 0.2) AS a, quantile_cont(c_acctbal, 0.4) AS b, quantile_cont(c_acctbal, 0.6) AS c, quantile_cont(c_acctbal, 0.8) AS e FROM customer GROUP BY 1)
    SELECT c_custkey, (c_acctbal > a)::INT + (c_acctbal > b)::INT + (c_acctbal > c)::INT + (c_acctbal > e)::INT AS bin FROM customer JOIN q USING (c_nationkey)""")
def win_qcut(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    q = c.groupBy("c_nationkey").agg(F.percentile("c_acctbal", [0.2, 0.4, 0.6, 0.8]).alias("q"))
    return c.join(q, "c_nationkey").select("c_custkey", F.size(F.filter("q", lambda e: F.col("c_acctbal") > e)).alias("bin"))


@query("win_ntile", "SELECT c_custkey, ntile(5) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS bin FROM customer")
def win_ntile(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.ntile(5).over(Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")).alias("bin"))


@query("win_sector_arc", DAILY + """, s AS (SELECT day, user_id % 8 AS sector, sum(n) AS n FROM n GROUP BY 1, 2), g AS (SELECT t.day, x.sector, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT day FROM s) t CROSS JOIN (SELECT unnest(range(0, 8)) AS sector) x LEFT JOIN s ON s.day = t.day AND s.sector = x.sector)
    SELECT a.day, a.sector, CAST(sum(b.n) AS BIGINT) AS arc FROM g a JOIN g b ON b.day = a.day AND (b.sector = a.sector OR b.sector = (a.sector + 1) % 8 OR b.sector = (a.sector + 7) % 8) GROUP BY 1, 2""")
def win_sector_arc(spark, d):
    s = daily(spark, d).groupBy("day", (F.col("user_id") % 8).alias("sector")).agg(F.sum("n").alias("n"))
    grid = s.select("day").distinct().withColumn("sector", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    # every sector sends its count to its two neighbours on the circle
    sent = s.select("day", F.explode(F.array(*(F.pmod(F.col("sector") + k, F.lit(8)) for k in (-1, 0, 1)))).alias("sector"), "n").groupBy("day", "sector").agg(F.sum("n").alias("arc"))
    return grid.join(sent, ["day", "sector"], "left").fillna(0, ["arc"])


INTERPOLATED = SPARSE + """, q AS (SELECT k, day, x, date_diff('day', DATE '2024-01-01', day) AS t FROM p),
    b AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN t END) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING) AS t0, min(CASE WHEN x IS NOT NULL THEN t END) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1 FROM q)
    SELECT b.k, b.day, {} FROM b LEFT JOIN q l ON l.k = b.k AND l.t = b.t0 LEFT JOIN q r ON r.k = b.k AND r.t = b.t1"""


@query("win_interpolate", INTERPOLATED.format("coalesce(b.x, l.x + (r.x - l.x) * (b.t - b.t0) / (b.t1 - b.t0)) AS y"))
def win_interpolate(spark, d):
    p = sparse(spark, d).withColumn("t", F.datediff("day", F.to_date(F.lit("2024-01-01"))))
    return p.select("k", "day", W.interpolated("x", "t", by(order="t")).alias("y"))


@query("nearest_fill", INTERPOLATED.format("CASE WHEN b.t0 IS NULL THEN r.x WHEN b.t1 IS NULL OR b.t - b.t0 <= b.t1 - b.t THEN l.x ELSE r.x END AS y"))
def nearest_fill(spark, d):
    p = sparse(spark, d).withColumn("t", F.datediff("day", F.to_date(F.lit("2024-01-01"))))
    known, w = F.when(F.col("x").isNotNull(), F.struct("t", "x")), by(order="t")
    p = p.withColumn("l", F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("r", F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    y = F.when(F.col("l").isNull(), F.col("r.x")).when(F.col("r").isNull() | (F.col("t") - F.col("l.t") <= F.col("r.t") - F.col("t")), F.col("l.x")).otherwise(F.col("r.x"))
    return p.select("k", "day", y.alias("y"))


@query("win_local_min", PANEL + ", l AS (SELECT *, lag(n) OVER w AS a, lead(n) OVER w AS b, max(n) OVER (PARTITION BY k ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS peak FROM p WINDOW w AS (PARTITION BY k ORDER BY day)) SELECT k, day, n, peak FROM l WHERE n < a AND n <= b")
def win_local_min(spark, d):
    p = panel(spark, d).withColumn("a", F.lag("n").over(by())).withColumn("b", F.lead("n").over(by())).withColumn("peak", F.max("n").over(by().rowsBetween(1, 5)))
    return p.where("n < a AND n <= b").select("k", "day", "n", "peak")


@query("greedy_suppression", DAILY + """, o AS (SELECT user_id, list(CAST(date_diff('day', DATE '1970-01-01', day) AS BIGINT) ORDER BY day) AS l FROM n GROUP BY 1)
    SELECT user_id, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] >= 5 THEN list_concat(a, x) ELSE a END)) AS t FROM o""")
def greedy_suppression(spark, d):
    return W.spaced(daily(spark, d).withColumn("t", F.unix_date("day")), ["user_id"], "t", 5)


@query("first_match_scan", PANEL + ", w AS (SELECT *, n + lead(n, 1) OVER w + lead(n, 2) OVER w AS s, CAST(sum(n) OVER (PARTITION BY k) AS DOUBLE) / 30 AS m FROM p WINDOW w AS (PARTITION BY k ORDER BY day)) SELECT k, min(CASE WHEN s > 3.3 * m THEN day END) AS onset FROM w GROUP BY 1")
def first_match_scan(spark, d):
    p = panel(spark, d)
    s = F.col("n") + F.lead("n", 1).over(by()) + F.lead("n", 2).over(by())
    p = p.withColumn("s", s).withColumn("m", F.sum("n").over(Window.partitionBy("k")) / 30)
    return p.groupBy("k").agg(F.min(F.when(F.col("s") > 3.3 * F.col("m"), F.col("day"))).alias("onset"))


@query("win_circular_smooth", """WITH h AS (SELECT hour(ts) AS h, count(*) AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS s FROM events GROUP BY 1), p AS (SELECT sum(s) / sum(n) AS p FROM h)
    SELECT a.h, round((sum(b.s) + 10 * any_value(p)) / (sum(b.n) + 10), 9) AS rate FROM h a JOIN h b ON least(abs(a.h - b.h), 24 - abs(a.h - b.h)) <= 2 CROSS JOIN p GROUP BY 1""")
def win_circular_smooth(spark, d):
    h = table(spark, d, "events").groupBy(F.hour("ts").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("s"))
    prior = F.broadcast(h.agg((F.sum("s") / F.sum("n")).alias("p")))
    # at most 24 rows of hours: each goes to the hours within two of it on the circle
    near = h.select(F.explode(F.array(*(F.pmod(F.col("h") + k, F.lit(24)) for k in range(-2, 3)))).alias("h"), "n", "s")
    wide = near.groupBy("h").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).join(h.select("h"), "h", "left_semi")
    return wide.crossJoin(prior).select("h", F.round((F.col("s") + 10 * F.col("p")) / (F.col("n") + 10), 9).alias("rate"))


@query("win_quarter_rank", "SELECT o_orderkey, rank() OVER (PARTITION BY year(o_orderdate), quarter(o_orderdate) ORDER BY o_totalprice DESC) AS r FROM orders")
def win_quarter_rank(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.rank().over(Window.partitionBy(F.year("o_orderdate"), F.quarter("o_orderdate")).orderBy(F.desc("o_totalprice"))).alias("r"))


@query("smooth_tricube", PANEL + """, d AS (SELECT a.k, a.day, b.n, date_diff('day', a.day, b.day) AS d FROM p a JOIN p b ON b.k = a.k AND abs(date_diff('day', a.day, b.day)) < 5), w AS (SELECT *, (1 - (abs(d) / 5.0) ** 3) ** 3 AS w FROM d),
    s AS (SELECT k, day, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * n) AS t0, sum(w * d * n) AS t1 FROM w GROUP BY 1, 2) SELECT k, day, round((s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1), 6) AS smooth FROM s""")
def smooth_tricube(spark, d):
    """The value at each day of a line fitted to the days around it, nearer ones weighing more; all in one window frame."""
    terms = []
    for j in range(-4, 5):
        n, weight = F.lag("n", -j).over(by()), (1 - (abs(j) / 5) ** 3) ** 3
        terms.append({"s0": (n, weight), "s1": (n, weight * j), "s2": (n, weight * j * j), "t0": (n, weight), "t1": (n, weight * j)})
    total = lambda name: sum((F.when(n.isNotNull(), n * w if name[0] == "t" else F.lit(w)).otherwise(0.0) for n, w in (t[name] for t in terms)), F.lit(0.0))
    s = panel(spark, d).select("k", "day", *(total(c).alias(c) for c in terms[0]))
    line = (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / (F.col("s0") * F.col("s2") - F.col("s1") ** 2)
    return s.select("k", "day", F.round(line, 6).alias("smooth"))


@query("curve_inverse", "WITH c AS (SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS y FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY y) AS k FROM c WHERE y >= 500) SELECT l_suppkey, l_shipdate AS reached, y FROM r WHERE k = 1")
def curve_inverse(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    c = table(spark, d, "lineitem").withColumn("y", F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("y >= 500")
    return c.groupBy("l_suppkey").agg(F.min(F.struct("y", "l_shipdate")).alias("m")).select("l_suppkey", F.col("m.l_shipdate").alias("reached"), "m.y")


@query("win_crossings", PANEL + ", b AS (SELECT k, day, n < (SELECT avg(n) FROM p) AS below FROM p), c AS (SELECT k, below AND NOT coalesce(lag(below) OVER (PARTITION BY k ORDER BY day), false) AS c FROM b) SELECT k, count(*) FILTER (WHERE c) AS troughs FROM c GROUP BY 1")
def win_crossings(spark, d):
    p = panel(spark, d)
    b = p.crossJoin(F.broadcast(p.agg(F.avg("n").alias("m")))).withColumn("below", F.col("n") < F.col("m"))
    return b.withColumn("c", W.crossings(F.col("below"), by())).groupBy("k").agg(F.count_if("c").alias("troughs"))


@query("deciles_sliced", "WITH r AS (SELECT c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) // 5 AS k FROM customer) SELECT c_nationkey, CAST(i // k AS BIGINT) AS q, round(avg(c_acctbal), 6) AS m FROM r WHERE k > 0 AND i // k < 5 GROUP BY 1, 2")
def deciles_sliced(spark, d):
    whole = Window.partitionBy("c_nationkey")
    q = W.sliced_bins(whole.orderBy("c_acctbal", "c_custkey"), whole, 5)
    return table(spark, d, "customer").withColumn("q", q.cast("long")).where("q IS NOT NULL").groupBy("c_nationkey", "q").agg(F.round(F.avg("c_acctbal"), 6).alias("m"))


@query("spi", PANEL + """, a AS (SELECT k, day, CAST(sum(n) OVER (PARTITION BY k ORDER BY day ROWS 2 PRECEDING) AS DOUBLE) AS s FROM p), m AS (SELECT *, avg(s) OVER (PARTITION BY k) AS mean, ln(greatest(avg(s) OVER (PARTITION BY k), 1e-9)) - avg(ln(greatest(s, 1e-9))) OVER (PARTITION BY k) AS a FROM a),
    f AS (SELECT *, CASE WHEN a > 1e-9 THEN (1 + sqrt(1 + 4 * a / 3)) / (4 * a) ELSE 100.0 END AS shape FROM m) SELECT k, day, round(3 * sqrt(shape) * (pow(greatest(s, 1e-9) / mean, 1 / 3.0) - 1 + 1 / (9 * shape)), 6) AS z FROM f""")
def spi(spark, d):
    """Three-day sums as standard normal values of a gamma distribution fitted to each series by its log moment (Wilson-Hilferty)."""
    whole, positive = Window.partitionBy("k"), lambda c: F.greatest(c, F.lit(1e-9))
    p = panel(spark, d).select("k", "day", F.sum("n").over(by().rowsBetween(-2, 0)).cast("double").alias("s"))
    m = p.withColumn("mean", F.avg("s").over(whole)).withColumn("a", F.log(positive(F.col("mean"))) - F.avg(F.log(positive(F.col("s")))).over(whole))
    f = m.withColumn("shape", F.when(F.col("a") > 1e-9, (1 + F.sqrt(1 + 4 * F.col("a") / 3)) / (4 * F.col("a"))).otherwise(100.0))
    z = 3 * F.sqrt("shape") * (F.pow(positive(F.col("s")) / F.col("mean"), F.lit(1 / 3)) - 1 + 1 / (9 * F.col("shape")))
    return f.select("k", "day", F.round(z, 6).alias("z"))
