"""Queries of scans, projections, filters, sorting, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.aggregates import dedupe
from ..sources.sinks import json_rows, replace_keys
from ..sources.tables import evolving, table
from .registry import query


@query("scan_parquet", "SELECT r_regionkey, r_name FROM region")
def scan_parquet(spark, d):
    return table(spark, d, "region").select("r_regionkey", "r_name")


@query("union_by_name", """SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer
    UNION ALL BY NAME SELECT s_suppkey AS key, s_name AS name FROM supplier""")
def union_by_name(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return evolving([c, s])


@query("scan_pruned", "SELECT o_orderkey, o_totalprice FROM orders")
def scan_pruned(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice")


@query("scan_pushdown", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate <= TIMESTAMP '1998-03-31'")
def scan_pushdown(spark, d):
    day = F.col("l_shipdate")
    return table(spark, d, "lineitem").where((day >= F.expr("TIMESTAMP_NTZ '1998-01-01'")) & (day <= F.expr("TIMESTAMP_NTZ '1998-03-31'"))).select("l_orderkey", "l_linenumber", "l_shipdate")


@query("json_explode", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_explode(spark, d):
    parsed = F.from_json("props", "map<string,bigint>")
    return table(spark, d, "events").select("event_id", F.explode_outer(parsed).alias("name", "k")).where("name = 'k'").select("event_id", "k")


@query("ctas", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def ctas(spark, d):
    table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).createOrReplaceTempView("customers_by_nation")
    return spark.table("customers_by_nation")


@query("values_register", "SELECT n_name, v.label FROM nation JOIN (VALUES (0, 'zero'), (1, 'one'), (2, 'two')) v(k, label) ON n_regionkey = v.k")
def values_register(spark, d):
    spark.sql("SELECT * FROM VALUES (0, 'zero'), (1, 'one'), (2, 'two') AS v(k, label)").createOrReplaceTempView("labels_of_regions")
    return table(spark, d, "nation").join(F.broadcast(spark.table("labels_of_regions")), F.col("n_regionkey") == F.col("k")).select("n_name", "label")


@query("cross_join_values", "SELECT r_regionkey, di, dj FROM region CROSS JOIN (VALUES (-1, -1), (0, 1), (1, 0)) AS o(di, dj)")
def cross_join_values(spark, d):
    offsets = F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in ((-1, -1), (0, 1), (1, 0))))
    return table(spark, d, "region").select("r_regionkey", F.inline(offsets))


@query("upsert_replace_keys", """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0
    UNION ALL SELECT o_orderkey, 'R', o_totalprice * 2 FROM orders WHERE o_orderkey % 10 = 0""")
def upsert_replace_keys(spark, d):
    old = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = old.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("R").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return replace_keys(old, new, ["o_orderkey"])


@query("json_sink_nan_safe", """SELECT n_nationkey, '{"k":' || n_nationkey || ',"x":' || CASE WHEN n_nationkey % 2 = 0 THEN 'null' ELSE '1.5' END || '}' AS json FROM nation""")
def json_sink_nan_safe(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 2 == 0, F.lit(float("nan"))).otherwise(1.5).alias("x"))
    return json_rows(rows).select(F.get_json_object("json", "$.k").cast("int").alias("n_nationkey"), "json")


@query("vec_quantize_int8", """WITH v AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    s AS (SELECT vec_id, max(abs(x)) AS s FROM v GROUP BY 1)
    SELECT vec_id, i - 1 AS i, CAST(round_even(x / s * 127, 0) AS INTEGER) AS q FROM v JOIN s USING (vec_id)""")
def vec_quantize_int8(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.array_max(F.transform("embedding", F.abs)).alias("s"))
    scaled = lambda x: ((x / F.col("s")).cast("float") * F.lit(127.0).cast("float")).cast("double")  # noqa: E731 -- quotient and product are single floats, as the components
    return e.select("vec_id", F.posexplode(F.transform("embedding", lambda x: F.bround(scaled(x), 0).cast("int"))).alias("i", "q"))


@query("project_computed", "SELECT o_orderkey, year(o_orderdate) AS y, o_totalprice / 1000 AS thousands FROM orders")
def project_computed(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), (F.col("o_totalprice") / 1000).alias("thousands"))


@query("filter_or", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey = 1 OR l_partkey = 1")
def filter_or(spark, d):
    return table(spark, d, "lineitem").where("l_suppkey = 1 OR l_partkey = 1").select("l_orderkey", "l_linenumber")


@query("filter_in", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'click')")
def filter_in(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("error", "click")).select("event_id", "event_type")


@query("filter_like_any", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'ECO%' OR p_type LIKE 'STA%'")
def filter_like_any(spark, d):
    return table(spark, d, "part").where(F.col("p_type").startswith("ECO") | F.col("p_type").startswith("STA")).select("p_partkey", "p_type")


@query("filter_bbox", "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 0 AND 1000 AND c_nationkey BETWEEN 3 AND 9")
def filter_bbox(spark, d):
    return table(spark, d, "customer").where(F.col("c_acctbal").between(0, 1000) & F.col("c_nationkey").between(3, 9)).select("c_custkey")


@query("filter_neq", "SELECT o_orderkey FROM orders WHERE o_orderpriority <> '' AND o_orderpriority <> '1-URGENT'")
def filter_neq(spark, d):
    return table(spark, d, "orders").where((F.col("o_orderpriority") != "") & (F.col("o_orderpriority") != "1-URGENT")).select("o_orderkey")


@query("project_isnull", "SELECT c_custkey, o_orderkey IS NULL AS no_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000")
def project_isnull(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 200000").select("o_custkey", "o_orderkey")
    return table(spark, d, "customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.isnull("o_orderkey").alias("no_order"))


@query("filter_regex", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)RING|^small')")
def filter_regex(spark, d):
    return table(spark, d, "part").where(F.coalesce(F.col("p_name").rlike("(?i)RING|^small"), F.lit(False))).select("p_partkey", "p_name")


@query("case_when", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount IS NULL OR l_discount <= 0 THEN l_extendedprice ELSE 0 END AS full_price FROM lineitem")
def case_when(spark, d):
    full = F.when(F.col("l_discount").isNull() | (F.col("l_discount") <= 0), F.col("l_extendedprice")).otherwise(0.0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", full.alias("full_price"))


CLASSES = [("l_quantity > 45", "bulk"), ("l_discount >= 0.08", "bargain"), ("l_tax = 0", "untaxed")]


@query("classify_first_match", """SELECT l_orderkey, l_linenumber,
    CASE WHEN l_quantity > 45 THEN 'bulk' WHEN l_discount >= 0.08 THEN 'bargain' WHEN l_tax = 0 THEN 'untaxed' ELSE 'plain' END AS first_wins,
    CASE WHEN l_tax = 0 THEN 'untaxed' WHEN l_discount >= 0.08 THEN 'bargain' WHEN l_quantity > 45 THEN 'bulk' ELSE 'plain' END AS last_wins FROM lineitem""")
def classify_first_match(spark, d):
    def ladder(rules):
        out = F.lit("plain")
        for test, name in reversed(rules):
            out = F.when(F.expr(test), name).otherwise(out)
        return out

    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ladder(CLASSES).alias("first_wins"), ladder(CLASSES[::-1]).alias("last_wins"))


@query("coalesce_nullif", "SELECT c_nationkey, sum(c_acctbal) / nullif(sum(CASE WHEN c_acctbal > 9000 THEN 1 ELSE 0 END), 0) AS per_rich, coalesce(max(CASE WHEN c_acctbal > 9990 THEN c_acctbal END), 0) AS top FROM customer GROUP BY 1")
def coalesce_nullif(spark, d):
    rich = F.sum(F.when(F.col("c_acctbal") > 9000, 1).otherwise(0))
    top = F.coalesce(F.max(F.when(F.col("c_acctbal") > 9990, F.col("c_acctbal"))), F.lit(0.0))
    return table(spark, d, "customer").groupBy("c_nationkey").agg((F.sum("c_acctbal") / F.nullif(rich, F.lit(0))).alias("per_rich"), top.alias("top"))


@query("try_cast", "SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS p, TRY_CAST(o_orderpriority AS INTEGER) AS bad, CAST(o_orderdate AS DATE) AS day FROM orders")
def try_cast(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).try_cast("int").alias("p"), F.col("o_orderpriority").try_cast("int").alias("bad"), F.to_date("o_orderdate").alias("day")
    )


@query("cast_downcast", "SELECT s_suppkey, CAST(s_acctbal AS FLOAT) AS s_acctbal FROM supplier")
def cast_downcast(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return s.select(*(F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in s.dtypes))


@query("select_prefix", "SELECT p_partkey AS key, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def select_prefix(spark, d):
    p = table(spark, d, "part")
    return p.select(*(c for c in p.columns if c.startswith("p_"))).withColumnsRenamed({"p_partkey": "key"})


@query("map_lookup", "SELECT o_orderkey, coalesce(CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' END, 'other') AS status FROM orders")
def map_lookup(spark, d):
    names = F.create_map(F.lit("F"), F.lit("filled"), F.lit("O"), F.lit("open"))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.try_element_at(names, "o_orderstatus"), F.lit("other")).alias("status"))


@query("filter_plausible", "SELECT count(*) FILTER (WHERE value BETWEEN 1 AND 50) AS kept, count(*) FILTER (WHERE NOT coalesce(value BETWEEN 1 AND 50, false)) AS dropped FROM events")
def filter_plausible(spark, d):
    ok = F.coalesce(F.col("value").between(1, 50), F.lit(False))
    return table(spark, d, "events").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


@query("filter_membership", "SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD') AS household FROM orders")
def filter_membership(spark, d):
    mask = table(spark, d, "customer").where("c_mktsegment = 'HOUSEHOLD'").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("household"))
    return table(spark, d, "orders").join(mask, "o_custkey", "left").select("o_orderkey", F.coalesce("household", F.lit(False)).alias("household"))


@query("filter_audit", """SELECT CASE WHEN l_quantity < 5 THEN 'small' WHEN l_discount > 0.09 THEN 'discount' ELSE 'kept' END AS reason, count(*) AS n,
    round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1""")
def filter_audit(spark, d):
    reason = F.when(F.col("l_quantity") < 5, "small").when(F.col("l_discount") > 0.09, "discount").otherwise("kept")
    return table(spark, d, "lineitem").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("clip", "SELECT c_custkey, greatest(least(c_acctbal, 5000.0), 0.0) AS clipped FROM customer")
def clip(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.greatest(F.least("c_acctbal", F.lit(5000.0)), F.lit(0.0)).alias("clipped"))


FLAGS = ("A", "N", "R")


@query("filter_agg_generated", "SELECT l_linestatus, " + ", ".join(f"count(*) FILTER (WHERE l_returnflag = '{f}') AS n_{f.lower()}" for f in FLAGS) + " FROM lineitem GROUP BY 1")
def filter_agg_generated(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(*(F.count_if(F.col("l_returnflag") == f).alias(f"n_{f.lower()}") for f in FLAGS))


@query("sort_multi", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY 2, 3 DESC, 1")
def sort_multi(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal").orderBy("c_nationkey", F.desc("c_acctbal"), "c_custkey")


@query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 2 DESC, 1 LIMIT 25")
def topk(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("nlargest_nsmallest", """(SELECT 'large' AS side, p_partkey, p_retailprice FROM part ORDER BY 3 DESC, 2 LIMIT 6)
    UNION ALL (SELECT 'small', p_partkey, p_retailprice FROM part ORDER BY 3, 2 LIMIT 6)""")
def nlargest_nsmallest(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    large = p.orderBy(F.desc("p_retailprice"), "p_partkey").limit(6).select(F.lit("large").alias("side"), "*")
    return large.unionAll(p.orderBy("p_retailprice", "p_partkey").limit(6).select(F.lit("small").alias("side"), "*"))


@query("topn_union_members", """WITH s AS (SELECT year(o_orderdate) AS y, o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY v DESC, o_custkey) AS k FROM s)
    SELECT DISTINCT o_custkey FROM r WHERE k <= 5""")
def topn_union_members(spark, d):
    s = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), "o_custkey").agg(F.sum("o_totalprice").alias("v"))
    k = F.row_number().over(Window.partitionBy("y").orderBy(F.desc("v"), "o_custkey"))
    return s.withColumn("k", k).where("k <= 5").select("o_custkey").distinct()


@query("topn_other", """WITH s AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY n DESC, c_nationkey) AS k FROM s)
    SELECT CASE WHEN k <= 5 THEN CAST(c_nationkey AS VARCHAR) ELSE 'other' END AS who, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def topn_other(spark, d):
    s = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    top = s.orderBy(F.desc("n"), "c_nationkey").limit(5).select("c_nationkey", F.col("c_nationkey").cast("string").alias("named"))
    return s.join(F.broadcast(top), "c_nationkey", "left").groupBy(F.coalesce("named", F.lit("other")).alias("who")).agg(F.sum("n").alias("n"))


@query("sample_hash", "SELECT event_id FROM events ORDER BY md5(CAST(event_id AS VARCHAR)) LIMIT 200")
def sample_hash(spark, d):
    return table(spark, d, "events").select("event_id").orderBy(F.md5(F.col("event_id").cast("string").cast("binary"))).limit(200)


@query("sample_weighted_neg", """SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 1.0 ELSE 16.0 END AS w FROM events
    WHERE event_type = 'error' OR substr(md5(CAST(event_id AS VARCHAR)), 1, 1) = '0'""")
def sample_weighted_neg(spark, d):
    rare = F.col("event_type") == "error"
    drawn = F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 1) == "0"
    return table(spark, d, "events").where(rare | drawn).select("event_id", "event_type", F.when(rare, 1.0).otherwise(16.0).alias("w"))


@query("sort_abs", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal), c_custkey LIMIT 50")
def sort_abs(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.abs("c_acctbal"), "c_custkey").limit(50)


@query("decimate", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE (k - 1) % 5 = 0")
def decimate(spark, d):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").withColumn("k", k).where("(k - 1) % 5 = 0").select("user_id", "event_id")


@query("precision_at_budget", """WITH r AS (SELECT l_suppkey, l_returnflag = 'R' AS hit, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k,
        count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
    SELECT l_suppkey, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS precision FROM r WHERE k <= round(n * 0.1) GROUP BY 1""")
def precision_at_budget(spark, d):
    whole = Window.partitionBy("l_suppkey")
    r = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_returnflag") == "R").cast("double").alias("hit"), F.row_number().over(whole.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")).alias("k"), F.count(F.lit(1)).over(whole).alias("n"))
    return r.where(F.col("k") <= F.round(F.col("n") * 0.1)).groupBy("l_suppkey").agg(F.avg("hit").alias("precision"))


@query("time_split", """WITH r AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, ts AS cut FROM r WHERE k = floor(n * 0.75) + 1""")
def time_split(spark, d):
    whole = Window.partitionBy("user_id")
    r = table(spark, d, "events").select("user_id", "ts", F.row_number().over(whole.orderBy("ts")).alias("k"), F.count(F.lit(1)).over(whole).alias("n"))
    return r.where(F.col("k") == F.floor(F.col("n") * 0.75) + 1).select("user_id", F.col("ts").alias("cut"))


@query("union_all_roles", "SELECT c_nationkey AS nation, 'buyer' AS role, c_acctbal AS v FROM customer UNION ALL SELECT s_nationkey, 'seller', s_acctbal FROM supplier")
def union_all_roles(spark, d):
    buyers = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("buyer").alias("role"), F.col("c_acctbal").alias("v"))
    return buyers.unionAll(table(spark, d, "supplier").select("s_nationkey", F.lit("seller"), "s_acctbal"))


@query("distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def distinct(spark, d):
    return table(spark, d, "part").select("p_brand", "p_type").distinct()


@query("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").select("o_custkey"))


@query("union_priority", """WITH u AS (SELECT c_nationkey AS k, 1 AS core FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT s_nationkey, 0 FROM supplier)
    SELECT k, max(core) AS core FROM u GROUP BY 1""")
def union_priority(spark, d):
    core = table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k"), F.lit(1).alias("core"))
    rest = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit(0).alias("core"))
    return dedupe(core.unionAll(rest), ["k"], [F.desc("core")])
