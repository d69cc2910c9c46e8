"""Queries of joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins as J
from ..sources.tables import table
from .registry import query


@query("join_inner_derived", """SELECT l_orderkey, l_linenumber, l_extendedprice / w.v AS share FROM lineitem
    JOIN (SELECT l_suppkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1) w USING (l_suppkey)""")
def join_inner_derived(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    w = line.groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("v"))
    return line.join(w, "l_suppkey").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("v")).alias("share"))


@query("join_using", "SELECT n_name, r_name FROM nation JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) USING (n_regionkey)")
def join_using(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), on=["n_regionkey"]).select("n_name", "r_name")


@query("join_left_multikey", """SELECT a.user_id, a.day, a.n, b.errors FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) a
    LEFT JOIN (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1, 2) b ON b.user_id = a.user_id AND b.day = a.day""")
def join_left_multikey(spark, d):
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    a = e.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))
    b = e.where("event_type = 'error'").groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("errors"))
    return a.join(b, ["user_id", "day"], "left")


@query("join_cast_key", """SELECT e.event_id, o.n FROM events e LEFT JOIN (SELECT CAST(o_custkey AS VARCHAR) AS k, count(*) AS n FROM orders GROUP BY 1) o ON CAST(e.user_id AS VARCHAR) = o.k""")
def join_cast_key(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    e = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("k"))
    return e.join(o, "k", "left").select("event_id", "n")


@query("join_full_fill", """SELECT coalesce(c.k, s.k) AS k, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM
    (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 8000 GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON c.k = s.k""")
def join_full_fill(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 8000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    s = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return c.join(s, "k", "full").fillna(0, ["customers", "suppliers"])


@query("join_right", "SELECT n_nationkey, n_name, s.n FROM (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 9000 GROUP BY 1) s RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 9000").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return s.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("n_nationkey", "n_name", "n")


@query("neighbor_dilate", """WITH c AS (SELECT DISTINCT CAST(floor(c_acctbal / 500) AS BIGINT) AS x, CAST(c_nationkey AS BIGINT) AS y FROM customer WHERE c_acctbal > 9000)
    SELECT x + di AS x, y + dj AS y, count(*) AS n FROM c CROSS JOIN (VALUES (-1), (0), (1)) a(di) CROSS JOIN (VALUES (-1), (0), (1)) b(dj) GROUP BY 1, 2""")
def neighbor_dilate(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 9000").select(J.cell(F.col("c_acctbal"), 500).alias("x"), F.col("c_nationkey").cast("long").alias("y")).distinct()
    return J.neighbours(c, "x", "y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


@query("semi_in", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def semi_in(spark, d):
    rich = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(rich, "o_custkey", "left_semi").select("o_orderkey")


@query("semi_in_correlated", """SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_suppkey IN
    (SELECT x.l_suppkey FROM lineitem x WHERE x.l_partkey = l.l_partkey AND x.l_quantity > 45)""")
def semi_in_correlated(spark, d):
    line = table(spark, d, "lineitem")
    return line.join(line.where("l_quantity > 45").select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_linenumber")


@query("anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("asof_backward", """SELECT e.event_id, e.user_id, p.value AS last_purchase FROM events e ASOF LEFT JOIN
    (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_backward(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    p = table(spark, d, "events").where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("last_purchase"))
    return J.asof_backward(e, p, ["user_id"], "ts", "at", ["last_purchase"]).select("event_id", "user_id", "last_purchase")


@query("range_join_sum", """WITH b AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT p.user_id, p.day, (SELECT CAST(sum(n) AS BIGINT) FROM b WHERE b.user_id = p.user_id AND b.day BETWEEN p.day - 7 AND p.day - 1) AS week_before FROM b p""")
def range_join_sum(spark, d):
    b = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    days = Window.partitionBy("user_id").orderBy(F.unix_date("day")).rangeBetween(-7, -1)  # the equi- and range join as one frame: no pairs
    return b.select("user_id", "day", F.sum("n").over(days).alias("week_before"))


@query("self_join_theta", """SELECT a.l_orderkey, a.l_linenumber AS first, b.l_linenumber AS second FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber > a.l_linenumber""")
def self_join_theta(spark, d):
    line = table(spark, d, "lineitem")
    a, b = line.select("l_orderkey", F.col("l_linenumber").alias("first")), line.select("l_orderkey", F.col("l_linenumber").alias("second"))
    return a.join(b, "l_orderkey").where("second > first")


@query("yoy_self_join", """WITH q AS (SELECT o_custkey, year(o_orderdate) * 4 + quarter(o_orderdate) AS t, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2)
    SELECT a.o_custkey, a.t, a.v, b.v AS year_before FROM q a JOIN q b ON b.o_custkey = a.o_custkey AND b.t = a.t - 4""")
def yoy_self_join(spark, d):
    t = (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).cast("long")
    q = table(spark, d, "orders").groupBy("o_custkey", t.alias("t")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return q.join(q.select("o_custkey", (F.col("t") + 4).alias("t"), F.col("v").alias("year_before")), ["o_custkey", "t"])


@query("lookup_default", "SELECT s_suppkey, coalesce(m.v, (SELECT round(avg(c_acctbal), 4) FROM customer)) AS v FROM supplier LEFT JOIN (SELECT c_nationkey, round(avg(c_acctbal), 4) AS v FROM customer WHERE c_nationkey < 12 GROUP BY 1) m ON c_nationkey = s_nationkey")
def lookup_default(spark, d):
    c = table(spark, d, "customer")
    m = c.where("c_nationkey < 12").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.round(F.avg("c_acctbal"), 4).alias("m"))
    grand = c.agg(F.round(F.avg("c_acctbal"), 4).alias("g"))
    return table(spark, d, "supplier").join(m, "s_nationkey", "left").crossJoin(F.broadcast(grand)).select("s_suppkey", F.coalesce("m", "g").alias("v"))


@query("align_series", """SELECT a.day, a.n AS clicks, b.n AS views FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) a
    JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) b USING (day)""")
def align_series(spark, d):
    n = lambda kind, name: table(spark, d, "events").where(F.col("event_type") == kind).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias(name))
    return n("click", "clicks").join(n("view", "views"), "day")


@query("densify_spine", """WITH n AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2, 3)
    SELECT k.user_id, k.event_type, s.day, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT user_id, event_type FROM n) k
    CROSS JOIN (SELECT CAST(unnest(generate_series((SELECT min(day) FROM n), (SELECT max(day) FROM n), INTERVAL 1 DAY)) AS DATE) AS day) s LEFT JOIN n ON n.user_id = k.user_id AND n.event_type = k.event_type AND n.day = s.day""")
def densify_spine(spark, d):
    n = table(spark, d, "events").groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return J.densify(n, ["user_id", "event_type"], "day").fillna(0, ["n"])


@query("join_broadcast_dim", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_broadcast_dim(spark, d):
    # nation and region have a fixed 25 and 5 rows at every scale
    dim = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(F.broadcast(dim), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("fuzzy_match_top1", """WITH p AS (SELECT DISTINCT p_name AS a FROM part), q AS (SELECT DISTINCT p_name || CASE WHEN p_partkey % 2 = 0 THEN 's' ELSE '' END AS b FROM part),
    r AS (SELECT a, b, 1 - levenshtein(a, b) / greatest(length(a), length(b)) AS ratio FROM p CROSS JOIN q),
    k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY ratio DESC, b) AS n FROM r WHERE ratio >= 0.8) SELECT a, b, ratio FROM k WHERE n = 1""")
def fuzzy_match_top1(spark, d):
    p = table(spark, d, "part")
    a = p.select(F.col("p_name").alias("a")).distinct()
    b = p.select(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "s").otherwise("")).alias("b")).distinct()
    return J.best_match(a, b, "a", "b").select("a", "b", "ratio")


@query("nearest_neighbor", """WITH r AS (SELECT s_suppkey, c_custkey, abs(s_acctbal - c_acctbal) AS gap, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - c_acctbal), c_custkey) AS k
    FROM supplier JOIN customer ON c_nationkey = s_nationkey) SELECT s_suppkey, c_custkey, round(gap, 4) AS gap FROM r WHERE k = 1""")
def nearest_neighbor(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_acctbal").alias("x"), "s_suppkey")
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("x")).agg(F.min("c_custkey").alias("c_custkey"))
    return J.nearest_value(s, c, "g", "x", "c_custkey").select("s_suppkey", "c_custkey", F.round("gap", 4).alias("gap"))


POINTS = "SELECT c_custkey AS id, c_acctbal / 100 AS x, (c_custkey % 1000) / 10.0 AS y FROM customer"


@query("distance_join", f"""WITH c AS ({POINTS}), s AS (SELECT s_suppkey AS sid, s_acctbal / 100 AS sx, (s_suppkey * 7 % 1000) / 10.0 AS sy FROM supplier)
    SELECT sid, count(*) AS n, round(sum(x), 4) AS total FROM s JOIN c ON sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) <= 8 GROUP BY 1""")
def distance_join(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") % 1000 / 10).alias("y"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sid"), (F.col("s_acctbal") / 100).alias("sx"), (F.col("s_suppkey") * 7 % 1000 / 10).alias("sy"))
    return J.sums_within(s, c, "sid", "sx", "sy", "x", "y", 8.0).select("sid", "n", F.round("total", 4).alias("total"))


@query("pairwise_within_r", """SELECT n_nationkey, count(*) FILTER (WHERE abs(s_acctbal - n_nationkey * 400) <= 500) AS near, round(coalesce(sum(CASE WHEN abs(s_acctbal - n_nationkey * 400) <= 500 THEN s_acctbal END), 0), 2) AS total
    FROM nation CROSS JOIN supplier GROUP BY 1""")
def pairwise_within_r(spark, d):
    # nation has 25 rows at every scale: its side is broadcast and suppliers are read once
    near = F.abs(F.col("s_acctbal") - F.col("n_nationkey") * 400) <= 500
    pairs = table(spark, d, "supplier").crossJoin(F.broadcast(table(spark, d, "nation").select("n_nationkey")))
    return pairs.groupBy("n_nationkey").agg(F.count_if(near).alias("near"), F.round(F.coalesce(F.sum(F.when(near, F.col("s_acctbal"))), F.lit(0.0)), 2).alias("total"))


@query("pairs_colocated", """SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE abs(a.s_acctbal - b.s_acctbal) <= 800""")
def pairs_colocated(spark, d):
    s = table(spark, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("a"), F.col("s_acctbal").alias("x"), J.cell(F.col("s_acctbal"), 800.0).alias("cell"))
    near = s.withColumnsRenamed({"a": "b", "x": "y"}).withColumn("cell", F.explode(F.array(*(F.col("cell") + k for k in (-1, 0, 1)))))
    return s.join(near, ["s_nationkey", "cell"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("x") - F.col("y")) <= 800)).select("a", "b")


@query("interval_overlap", """SELECT o_orderkey, greatest(0, date_diff('day', greatest(CAST(o_orderdate AS DATE), DATE '1998-03-01'), least(CAST(o_orderdate AS DATE) + 30, DATE '1998-03-31')) + 1) AS days
    FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1998-03-31' AND CAST(o_orderdate AS DATE) + 30 >= DATE '1998-03-01'""")
def interval_overlap(spark, d):
    a = F.to_date("o_orderdate")
    lo, hi = F.to_date(F.lit("1998-03-01")), F.to_date(F.lit("1998-03-31"))
    return table(spark, d, "orders").where((a <= hi) & (F.date_add(a, 30) >= lo)).select("o_orderkey", J.overlap_days(a, F.date_add(a, 30), lo, hi).cast("long").alias("days"))


@query("adjacency_edges", """WITH c AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'error')
    SELECT a.user_id AS u, b.user_id AS v, a.day FROM c a JOIN c b ON abs(a.user_id - b.user_id) <= 1 AND abs(date_diff('day', a.day, b.day)) <= 1 AND (a.user_id, a.day) < (b.user_id, b.day)""")
def adjacency_edges(spark, d):
    c = table(spark, d, "events").where("event_type = 'error'").select("user_id", F.unix_date(F.to_date("ts")).alias("t")).distinct()
    near = J.neighbours(c.select(F.col("user_id").alias("v"), F.col("t").alias("s"), F.col("user_id").alias("x"), F.col("t").alias("y")), "x", "y")
    joined = c.join(near, (F.col("user_id") == F.col("x")) & (F.col("t") == F.col("y")))
    ordered = (F.col("user_id") < F.col("v")) | (F.col("user_id") == F.col("v")) & (F.col("t") < F.col("s"))
    return joined.where(ordered).select(F.col("user_id").alias("u"), "v", F.date_from_unix_date("t").alias("day"))


@query("grid_coarse_join", """WITH f AS (SELECT c_custkey, CAST(floor(c_acctbal / 100) AS BIGINT) AS cell FROM customer), g AS (SELECT CAST(floor(s_acctbal / 250) AS BIGINT) AS coarse, count(*) AS n FROM supplier GROUP BY 1)
    SELECT c_custkey, n FROM f JOIN g ON CAST(floor(cell * 2 / 5) AS BIGINT) = coarse""")
def grid_coarse_join(spark, d):
    f = table(spark, d, "customer").select("c_custkey", J.cell(F.col("c_acctbal"), 100).alias("cell"))
    g = table(spark, d, "supplier").groupBy(J.cell(F.col("s_acctbal"), 250).alias("coarse")).agg(F.count(F.lit(1)).alias("n"))
    return f.withColumn("coarse", F.floor(F.col("cell") * 2 / 5).cast("long")).join(g, "coarse").select("c_custkey", "n")


@query("interval_to_spine", """WITH o AS (SELECT o_orderstatus AS stage, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 20 AS b FROM orders),
    w AS (SELECT stage, unnest(generate_series(date_trunc('week', a), b, INTERVAL 7 DAY)) AS wk, a, b FROM o)
    SELECT stage, CAST(wk AS DATE) AS week, count(*) AS n FROM w GROUP BY 1, 2""")
def interval_to_spine(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("stage"), F.to_date("o_orderdate").alias("a"))
    weeks = F.sequence(F.to_date(F.date_trunc("week", "a")), F.date_add("a", 20), F.expr("INTERVAL 7 DAYS"))
    return o.select("stage", F.explode(weeks).alias("week")).groupBy("stage", "week").agg(F.count(F.lit(1)).alias("n"))


@query("sample_max_merge", """SELECT c_custkey, max(p_size) AS class FROM customer LEFT JOIN part ON CAST(floor(p_retailprice / 50) AS BIGINT) = CAST(floor(c_acctbal / 50) AS BIGINT) AND p_size > 40 GROUP BY 1""")
def sample_max_merge(spark, d):
    tiles = table(spark, d, "part").where("p_size > 40").groupBy(J.cell(F.col("p_retailprice"), 50).alias("cell")).agg(F.max("p_size").alias("class"))
    return table(spark, d, "customer").select("c_custkey", J.cell(F.col("c_acctbal"), 50).alias("cell")).join(tiles, "cell", "left").select("c_custkey", "class")


#: Corners of a ring around its centre, not convex.
RING = [(-12.0, -9.0), (13.0, -7.0), (10.0, 12.0), (1.0, 2.0), (-11.0, 10.0)]


@query("point_in_polygon", f"""WITH c AS ({POINTS}), o AS (SELECT * FROM (VALUES {", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(RING))}) v(i, x, y)),
    v AS (SELECT n_nationkey AS zone, i, n_nationkey * 17 % 100 + x AS x, n_nationkey * 29 % 100 + y AS y FROM nation CROSS JOIN o),
    e AS (SELECT a.zone, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON b.zone = a.zone AND b.i = (a.i + 1) % {len(RING)} WHERE a.y <> b.y),
    h AS (SELECT id, zone, count(*) AS n FROM c JOIN e ON c.y >= least(y1, y2) AND c.y < greatest(y1, y2) AND c.x < x1 + (c.y - y1) * (x2 - x1) / (y2 - y1) GROUP BY 1, 2) SELECT id, zone FROM h WHERE n % 2 = 1""")
def point_in_polygon(spark, d):
    """Points joined to the zones of a polygon table that hold them; a point may be in several or none."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") % 1000 / 10).alias("y"))
    corners = F.array(*(F.struct((F.col("n_nationkey") * 17 % 100 + dx).alias("x"), (F.col("n_nationkey") * 29 % 100 + dy).alias("y")) for dx, dy in RING))
    zones = table(spark, d, "nation").select(F.col("n_nationkey").alias("zone"), corners.alias("ring"))
    return J.in_polygons(c, zones, "x", "y", "ring", 10.0).select("id", "zone")


@query("reconcile_two_stage", """WITH a AS (SELECT n_nationkey AS k, n_name FROM nation), b AS (SELECT n_nationkey AS code, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) || ' ' ELSE n_name END AS name FROM nation WHERE n_nationkey <> 4)
    SELECT a.k, b.code, CASE WHEN a.n_name = b.name THEN 'exact' ELSE 'normalised' END AS how FROM a JOIN b ON lower(trim(a.n_name)) = lower(trim(b.name))""")
def reconcile_two_stage(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    b = table(spark, d, "nation").where("n_nationkey <> 4").select(F.col("n_nationkey").alias("code"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lower("n_name"), F.lit(" "))).otherwise(F.col("n_name")).alias("name"))
    exact = a.join(b, F.col("n_name") == F.col("name")).select("k", "code", F.lit("exact").alias("how"))
    norm = lambda c: F.lower(F.trim(c))
    rest_a, rest_b = a.join(exact, "k", "left_anti"), b.join(exact, "code", "left_anti").withColumn("key", norm("name"))
    single = rest_b.join(rest_b.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c = 1"), "key")  # ambiguous names match nothing
    return exact.unionByName(rest_a.join(single, norm("n_name") == F.col("key")).select("k", "code", F.lit("normalised").alias("how")))
