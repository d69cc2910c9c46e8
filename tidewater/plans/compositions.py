"""Round trips through files, models, and end-to-end queries put together from the operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators.joins import densify
from ..operators.search import nearest_products
from ..sources import sinks, tables
from ..sources.shared import written
from ..sources.tables import table
from .analysing import rnd
from .registry import query
from .streams import shared
from .windowing import PANEL, by, panel

SUPPLIERS = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"
SUPPLIER_DDL = "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"


def supplier_csv(spark, d, **options):
    path = shared(spark)
    table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal").write.options(header=True, **options).csv(path)
    return path


@query("scan_csv_typed", SUPPLIERS)
def scan_csv_typed(spark, d):
    return tables.typed_csv(spark, supplier_csv(spark, d), SUPPLIER_DDL)


@query("scan_csv_varchar", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def scan_csv_varchar(spark, d):
    return tables.text_csv(spark, supplier_csv(spark, d), ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]).select("s_suppkey", "s_name")


@query("scan_csv_gzip", SUPPLIERS)
def scan_csv_gzip(spark, d):
    return tables.typed_csv(spark, supplier_csv(spark, d, compression="gzip"), SUPPLIER_DDL)


@query("scan_csv_zip", SUPPLIERS)
def scan_csv_zip(spark, d):
    """Suppliers by nation as members of zip archives, one for every 500 suppliers, packed by tasks and read back member by member."""
    lines = table(spark, d, "supplier").select(F.floor(F.col("s_suppkey") / 500).cast("string").alias("archive"), F.concat(F.lit("part_"), F.col("s_nationkey").cast("string"), F.lit(".csv")).alias("member"), F.concat_ws(",", "s_suppkey", "s_name", "s_nationkey", "s_acctbal").alias("line"))
    path = shared(spark)
    tables.zipped(lines, "archive", "member", "line", "s_suppkey,s_name,s_nationkey,s_acctbal").write.parquet(path)
    return tables.zip_csv(spark.read.parquet(path).select("content"), r"part_\d+\.csv", SUPPLIER_DDL)


@query("scan_tsv_prefilter", "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type FROM events WHERE event_type = 'error'")
def scan_tsv_prefilter(spark, d):
    path = shared(spark)
    table(spark, d, "events").select(F.concat_ws("\t", F.col("event_id").cast("string"), "event_type", "props").alias("value")).write.text(path)
    return tables.prefiltered_tsv(spark, path, ["event_id", "event_type"], ["error"], F.col("event_type") == "error")


@query("text_wide_to_long", """WITH m AS (SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS n FROM orders GROUP BY 1, 2), y AS (SELECT DISTINCT year FROM m)
    SELECT y.year, CAST(s.month AS INTEGER) AS month, CAST(m.n AS DOUBLE) AS value FROM y CROSS JOIN (SELECT unnest(range(1, 13)) AS month) s LEFT JOIN m ON m.year = y.year AND m.month = s.month""")
def text_wide_to_long(spark, d):
    path = shared(spark)
    months = table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
    wide = months.groupBy("y").pivot("m", list(range(1, 13))).count()
    wide.select(F.concat_ws("  ", F.col("y").cast("string"), *(F.coalesce(F.col(str(k)).cast("string"), F.lit("-99.9")) for k in range(1, 13))).alias("value")).write.text(path)
    return tables.wide_text_to_long(spark, path, -99.9)


@query("sink_parquet", SUPPLIERS)
def sink_parquet(spark, d):
    path = shared(spark)
    sinks.write_parquet(table(spark, d, "supplier"), path)
    return spark.read.parquet(path).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query("sink_partitioned", "SELECT o_orderkey, year(o_orderdate) AS y FROM orders")
def sink_partitioned(spark, d):
    path = shared(spark)
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    sinks.write_parquet(o, path, by=["y"])
    sinks.write_parquet(o.where("y = 1997"), path, mode="overwrite", by=["y"])  # replaces that year alone
    return spark.read.schema("o_orderkey long, y int").parquet(path)


@query("sink_append", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def sink_append(spark, d):
    path = shared(spark)
    for status in "FO":
        sinks.write_parquet(table(spark, d, "orders").where(F.col("o_orderstatus") == status).select("o_orderkey"), path, mode="append")
    return spark.read.parquet(path)


@query("decomp_factor", """WITH m AS (SELECT l_suppkey, count(*) AS n, avg(l_quantity) AS q, sum(l_extendedprice) / sum(l_quantity) AS p FROM lineitem GROUP BY 1), b AS (SELECT exp(avg(ln(n))) AS n, exp(avg(ln(q))) AS q, exp(avg(ln(p))) AS p FROM m)
    SELECT l_suppkey, round(ln(m.n / b.n), 6) AS by_count, round(ln(m.q / b.q), 6) AS by_size, round(ln(m.p / b.p), 6) AS by_price FROM m, b""")
def decomp_factor(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("q"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("p"))
    b = F.broadcast(m.agg(*(F.avg(F.log(c)).alias(f"b{c}") for c in "nqp")))
    return m.crossJoin(b).select("l_suppkey", *(rnd(F.log(c) - F.col(f"b{c}"), name) for c, name in zip("nqp", ("by_count", "by_size", "by_price"), strict=True)))


@query("identity_check", "WITH s AS (SELECT c_nationkey, abs(c_acctbal) * 1000 / avg(abs(c_acctbal)) OVER (PARTITION BY c_nationkey) AS x FROM customer), g AS (SELECT c_nationkey, abs(avg(x) - 1000) AS e FROM s GROUP BY 1) SELECT count(*) AS groups, CAST(count(*) FILTER (WHERE e > 1e-6) AS INTEGER) AS broken FROM g")
def identity_check(spark, d):
    c = table(spark, d, "customer")
    scaled = c.withColumn("x", F.abs("c_acctbal") * 1000 / F.avg(F.abs("c_acctbal")).over(Window.partitionBy("c_nationkey")))
    off = scaled.groupBy("c_nationkey").agg(F.abs(F.avg("x") - 1000).alias("e"))
    return off.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("e") > 1e-6).cast("int").alias("broken"))


@query("ols_se", """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_r2(l_extendedprice, l_quantity) AS r2, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, count(*) AS n FROM lineitem)
    SELECT round(b, 4) AS slope, round(sqrt(syy * (1 - r2) / (n - 2) / sxx), 4) AS se FROM f""")
def ols_se(spark, d):
    y, x = "l_extendedprice", "l_quantity"
    f = table(spark, d, "lineitem").agg(F.regr_slope(y, x).alias("b"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.count(F.lit(1)).alias("n"))
    return f.select(rnd("b", "slope", 4), rnd(F.sqrt(F.col("syy") * (1 - F.col("r2")) / (F.col("n") - 2) / F.col("sxx")), "se", 4))


@query("threshold_for_precision", """WITH r AS (SELECT l_suppkey, l_extendedprice AS s, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS p FROM lineitem)
    SELECT l_suppkey, min(s) AS threshold FROM r WHERE p >= 0.4 GROUP BY 1""")
def threshold_for_precision(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").rowsBetween(Window.unboundedPreceding, 0)
    r = table(spark, d, "lineitem").withColumn("p", F.avg((F.col("l_returnflag") == "R").cast("double")).over(w))
    return r.where("p >= 0.4").groupBy("l_suppkey").agg(F.min("l_extendedprice").alias("threshold"))


@query("harmonic_fit")
def harmonic_fit(spark, d):
    def fit(pdf):
        import numpy as np
        import pandas as pd

        t = (pd.to_datetime(pdf["day"]) - pd.Timestamp("2024-01-01")).dt.days.to_numpy(float)
        x = np.stack([np.ones_like(t), t, np.sin(2 * np.pi * t / 7), np.cos(2 * np.pi * t / 7)], axis=1)
        beta = np.linalg.lstsq(x, pdf["n"].to_numpy(float), rcond=None)[0]
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "trend": [float(beta[1])], "amplitude": [float(np.hypot(beta[2], beta[3]))]})

    return panel(spark, d).select("k", "day", "n").groupBy("k").applyInPandas(fit, "k string, trend double, amplitude double")


@query("deseasonalize", PANEL + ", m AS (SELECT k, isodow(day) AS w, avg(n) AS m FROM p GROUP BY 1, 2), g AS (SELECT k, avg(n) AS g FROM p GROUP BY 1) SELECT p.k, p.day, round(p.n - m.m + g.g, 6) AS adjusted FROM p JOIN m ON m.k = p.k AND m.w = isodow(p.day) JOIN g ON g.k = p.k")
def deseasonalize(spark, d):
    p = panel(spark, d)
    weekday, whole = Window.partitionBy("k", F.weekday("day")), Window.partitionBy("k")
    return p.select("k", "day", rnd(F.col("n") - F.avg("n").over(weekday) + F.avg("n").over(whole), "adjusted"))


@query("eci")
def eci(spark, d):
    """Complexity of nations from which brands they buy: the second eigenvector, by power iteration over the nation-nation table.

    Where all nations hold the same brands there is none, and all have 0.
    """
    from .analysing import brand_holders

    has = brand_holders(spark, d).withColumnsRenamed({"c_nationkey": "c", "p_brand": "p"})
    kc, kp = has.groupBy("c").agg(F.count(F.lit(1)).alias("kc")), has.groupBy("p").agg(F.count(F.lit(1)).alias("kp"))
    weighted = has.join(kc, "c").join(kp, "p").withColumn("w", 1 / (F.col("kc") * F.col("kp")))
    pairs = weighted.select("c", "p", "w").join(has.select(F.col("c").alias("c2"), "p"), "p").groupBy("c", "c2").agg(F.sum("w").alias("m"))
    now = kc.select("c", "kc", (F.col("c") % 7 - 3.0).alias("x"))
    pairs, now = written(pairs), written(now)
    for _ in range(12):
        mean = now.agg((F.sum(F.col("x") * F.col("kc")) / F.sum("kc")).alias("mu"), F.max(F.abs("x")).alias("top"))
        centred = now.crossJoin(F.broadcast(mean)).select("c", "kc", F.when(F.col("top") > 1e-9, (F.col("x") - F.col("mu")) / F.col("top")).otherwise(0.0).alias("x"))  # takes the first eigenvector out
        step = pairs.join(centred.select(F.col("c").alias("c2"), "x"), "c2").groupBy("c").agg(F.sum(F.col("m") * F.col("x")).alias("x"))
        now = written(kc.join(step, "c"))
    sign = F.broadcast(now.agg(F.signum(F.covar_pop("x", "kc")).alias("s")))  # no correlation: all nations may hold as many brands
    return now.crossJoin(sign).select("c", (F.col("x") * F.when(F.col("s") < 0, -1).otherwise(1)).alias("eci"))


def scored_lines(spark, d):
    from pyspark.ml.feature import VectorAssembler

    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("label"))
    return VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features").transform(x)


@query("ml_gbt")
def ml_gbt(spark, d):
    from pyspark.ml.regression import GBTRegressor

    x = scored_lines(spark, d)
    # the fit keeps its rows and passes over them again for every level; sorted, as splits are drawn from a sample by place
    order = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "label"]
    model = GBTRegressor(maxIter=5, maxDepth=3, seed=1).fit(A.dealt(x.where("l_orderkey % 5 <> 0"), order).sortWithinPartitions(*order))
    return model.transform(x.where("l_orderkey % 5 = 0")).select("l_orderkey", "l_linenumber", "label", "prediction")


@query("ml_isotonic")
def ml_isotonic(spark, d):
    from pyspark.ml.regression import IsotonicRegression

    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("features"), (F.col("l_returnflag") == "R").cast("double").alias("label"))
    return IsotonicRegression().fit(x).transform(x).select("l_orderkey", "l_linenumber", "prediction")


@query("ml_score", "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(0.05 * l_quantity - 10 * l_discount))), 9) AS p FROM lineitem")
def ml_score(spark, d):
    logit = 0.05 * F.col("l_quantity") - 10 * F.col("l_discount")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rnd(1 / (1 + F.exp(-logit)), "p", 9))


@query("panel_build", """WITH n AS (SELECT user_id AS k, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2),
    p AS (SELECT u.k, s.day, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT k FROM n) u CROSS JOIN (SELECT CAST(unnest(generate_series((SELECT min(day) FROM n), (SELECT max(day) FROM n), INTERVAL 1 DAY)) AS DATE) AS day) s LEFT JOIN n ON n.k = u.k AND n.day = s.day),
    b AS (SELECT k + i AS k, day, sum(n) AS near FROM p CROSS JOIN (VALUES (-1), (1)) o(i) GROUP BY 1, 2)
    SELECT p.k, p.day, p.n, CAST(coalesce(b.near, 0) AS BIGINT) AS near, CAST(sum(p.n) OVER (PARTITION BY p.k ORDER BY p.day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS BIGINT) AS before7, lead(p.n, 1) OVER (PARTITION BY p.k ORDER BY p.day) AS next FROM p LEFT JOIN b ON b.k = p.k AND b.day = p.day""")
def panel_build(spark, d):
    n = table(spark, d, "events").groupBy(F.col("user_id").alias("k"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    p = densify(n, ["k"], "day").fillna(0, ["n"])
    near = p.select(F.explode(F.array(F.col("k") - 1, F.col("k") + 1)).alias("k"), "day", "n").groupBy("k", "day").agg(F.sum("n").alias("near"))
    return p.join(near, ["k", "day"], "left").fillna(0, ["near"]).select("k", "day", "n", "near", F.sum("n").over(by().rowsBetween(-7, -1)).alias("before7"), F.lead("n").over(by()).alias("next"))


@query("daily_ledger", """WITH t AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, event_type) AS k FROM t)
    SELECT day, CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (WHERE event_type = 'error'), 0) AS BIGINT) AS errors, string_agg(event_type || ':' || n, ',' ORDER BY k) FILTER (WHERE k <= 2) AS top FROM r GROUP BY 1""")
def daily_ledger(spark, d):
    t = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "event_type", "n"))), 1, 2)
    top = F.array_join(F.transform(ordered, lambda x: F.concat(x["event_type"], F.lit(":"), x["n"].cast("string"))), ",")
    return t.groupBy("day").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("event_type") == "error", F.col("n"))), F.lit(0)).alias("errors"), top.alias("top"))


@query("sample_and_matrix", """WITH ok AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 8) SELECT o_custkey, o_orderstatus, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_custkey IN (SELECT o_custkey FROM ok) GROUP BY 1, 2""")
def sample_and_matrix(spark, d):
    o = table(spark, d, "orders")
    ok = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 8").select("o_custkey")
    return o.join(ok, "o_custkey", "left_semi").groupBy("o_custkey", "o_orderstatus").agg(rnd(F.sum("o_totalprice"), "v", 2))


@query("publisher_concentration", r"""WITH s AS (SELECT CASE WHEN h LIKE '%.net' THEN 'net' WHEN h LIKE '%.org' THEN 'org' ELSE 'com' END AS zone, h, count(*) AS n FROM (SELECT lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS h FROM pages) GROUP BY 1, 2),
    t AS (SELECT *, n / sum(n) OVER (PARTITION BY zone) AS s, row_number() OVER (PARTITION BY zone ORDER BY n DESC, h) AS k FROM s) SELECT zone, round(sum(s * s), 8) AS hhi, round(sum(s) FILTER (WHERE k <= 3), 8) AS top3 FROM t GROUP BY 1""")
def publisher_concentration(spark, d):
    h = S.host_of(F.col("url"))
    p = table(spark, d, "pages").select(h.alias("h"), F.when(h.endswith(".net"), "net").when(h.endswith(".org"), "org").otherwise("com").alias("zone"), F.lit(1).alias("one"))
    s = A.shares(p, ["zone"], "h", "one")
    return s.groupBy("zone").agg(rnd(F.sum(F.col("share") ** 2), "hhi", 8), rnd(F.sum(F.when(F.col("rank") <= 3, F.col("share"))), "top3", 8))


@query("survivorship", "WITH f AS (SELECT user_id, min(CAST(ts AS DATE)) AS first, max(CAST(ts AS DATE)) AS last FROM events GROUP BY 1) SELECT first, count(*) AS n, count(*) FILTER (WHERE last >= first + 14) AS after14, count(*) FILTER (WHERE last >= first + 28) AS after28 FROM f GROUP BY 1")
def survivorship(spark, d):
    f = table(spark, d, "events").groupBy("user_id").agg(F.min(F.to_date("ts")).alias("first"), F.max(F.to_date("ts")).alias("last"))
    return f.groupBy("first").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("last") >= F.date_add("first", k)).alias(f"after{k}") for k in (14, 28)))


@query("access_equity", """WITH a AS (SELECT c_nationkey AS g, c_custkey, count(o_orderkey) FILTER (WHERE o_totalprice <= 150000) AS reached FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
    r AS (SELECT g, reached, row_number() OVER w AS k, count(*) OVER (PARTITION BY g) AS n, sum(reached) OVER (PARTITION BY g) AS t FROM a WINDOW w AS (PARTITION BY g ORDER BY reached, c_custkey))
    SELECT g, round(avg(reached), 6) AS mean, round(sum((2 * k - n - 1) * reached) / nullif(any_value(n) * any_value(t), 0), 6) AS gini FROM r GROUP BY 1""")
def access_equity(spark, d):
    o = table(spark, d, "orders").where("o_totalprice <= 150000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("reached"))
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), "c_custkey").join(o, "c_custkey", "left").fillna(0, ["reached"]).withColumn("w", F.lit(1.0))
    mean = a.groupBy("g").agg(rnd(F.avg("reached"), "mean"))
    return mean.join(A.gini(a, ["g"], "reached", "w", "c_custkey"), "g").select("g", "mean", rnd("gini", "gini"))


@query("area_flow_vs_stock", PANEL + ", f AS (SELECT k, day, n, lag(n, 3) OVER (PARTITION BY k ORDER BY day) AS gone FROM p) SELECT k, day, CAST(sum(n - coalesce(gone, 0)) OVER (PARTITION BY k ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stock FROM f")
def area_flow_vs_stock(spark, d):
    p = panel(spark, d).withColumn("net", F.col("n") - F.coalesce(F.lag("n", 3).over(by()), F.lit(0)))
    return p.select("k", "day", F.sum("net").over(by().rowsBetween(Window.unboundedPreceding, 0)).alias("stock"))


@query("anchor_foreign", """WITH e AS (SELECT CAST(ts AS DATE) AS day, user_id % 2 AS side, value FROM events), r AS (SELECT day, side, value, row_number() OVER (PARTITION BY day, side ORDER BY value) AS k, count(*) OVER (PARTITION BY day, side) AS n FROM e)
    SELECT day, max(CASE WHEN side = 0 THEN value END) AS home, max(CASE WHEN side = 1 THEN value END) AS foreign_ FROM r WHERE k = n // 2 + 1 GROUP BY 1""")
def anchor_foreign(spark, d):
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), (F.col("user_id") % 2).alias("side"), "value")
    m = A.upper_median(e, ["day", "side"], "value")
    return m.groupBy("day").agg(F.max(F.when(F.col("side") == 0, F.col("median"))).alias("home"), F.max(F.when(F.col("side") == 1, F.col("median"))).alias("foreign_"))


SEMANTIC = """WITH s AS (SELECT q.vec_id AS q, e.vec_id AS hit, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id),
    r AS (SELECT *, max(s) OVER (PARTITION BY q) AS best, row_number() OVER (PARTITION BY q ORDER BY s DESC, hit) AS k FROM s) SELECT q, hit, round(s, 6) AS s FROM r WHERE k <= 40 AND round(s, 6) >= round(best, 6) - 0.05"""


def semantic_hits(spark, d, queries):
    """q, hit and s: for each query vector up to 40 nearest others, within 0.05 of the best."""
    e = table(spark, d, "embeddings")
    s = nearest_products(e, "vec_id", "embedding", e.where(queries), 40).select("q", F.col("vec_id").alias("hit"), rnd("s", "s"))
    best = F.max("s").over(Window.partitionBy("q"))  # 40 rows a query
    return s.withColumn("best", best).where(F.col("s") >= F.col("best") - 0.05).select("q", "hit", "s")


@query("search_semantic", SEMANTIC)
def search_semantic(spark, d):
    return semantic_hits(spark, d, "vec_id % 50 = 0")


@query("search_hybrid")
def search_hybrid(spark, d):
    """Lexical hits first, then semantic ones, of every vector whose id is divisible by 50, that are not among them."""
    from .scalars import search_lexical

    lexical = search_lexical(spark, d).select(F.col("doc_id").alias("hit"), F.lit(0).alias("kind"), F.col("score").alias("s"))
    semantic = semantic_hits(spark, d, "vec_id % 50 = 0").groupBy("hit").agg(F.max("s").alias("s")).select("hit", F.lit(1).alias("kind"), "s")
    return A.dedupe(lexical.unionByName(semantic), ["hit"], [F.col("kind"), F.desc("s")])
