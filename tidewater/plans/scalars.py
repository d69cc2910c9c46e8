"""Queries of scalar functions: strings, dates, numbers, geometry, arrays, JSON and vectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.search import lexical_hits, nearest_products
from ..sources.tables import table
from .registry import query


@query("str_substr", "SELECT p_partkey, substr(p_type, 1, 3) AS a, left(p_brand, 5) AS b, substr(p_name, 1, length(p_name) - 3) AS c FROM part")
def str_substr(spark, d):
    return table(spark, d, "part").select("p_partkey", F.substring("p_type", 1, 3).alias("a"), F.left("p_brand", F.lit(5)).alias("b"), F.substr("p_name", F.lit(1), F.length("p_name") - 3).alias("c"))


@query("str_pad_concat", "SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS z, o_orderstatus || ':' || o_orderkey AS c, strftime(o_orderdate, '%Y-%m') AS ym FROM orders")
def str_pad_concat(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("z"), F.concat("o_orderstatus", F.lit(":"), F.col("o_orderkey").cast("string")).alias("c"), F.date_format("o_orderdate", "yyyy-MM").alias("ym"))


@query("str_clean", "SELECT p_partkey, lower(trim('  ' || p_name || ' ')) AS a, upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS b, split_part(p_name, ' ', 1) AS c FROM part")
def str_clean(spark, d):
    return table(spark, d, "part").select("p_partkey", F.lower(F.trim(F.concat(F.lit("  "), "p_name", F.lit(" ")))).alias("a"), F.initcap("p_type").alias("b"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("c"))


@query("str_regex", r"SELECT c_custkey, regexp_replace(c_name, '#.*$', '') AS a, regexp_extract(c_name, '(\d+)', 1) AS b, regexp_matches(c_name, '7$') AS e FROM customer")
def str_regex(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.regexp_replace("c_name", "#.*$", "").alias("a"), F.regexp_extract("c_name", r"(\d+)", 1).alias("b"), F.col("c_name").rlike("7$").alias("e"))


@query("url_site_of", r"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host FROM pages), l AS (SELECT *, string_split(host, '.') AS l FROM h)
    SELECT page_id, host, CASE WHEN len(l) <= 2 THEN host WHEN l[-2] || '.' || l[-1] IN ('co.uk', 'co.id', 'com.au', 'go.id', 'ac.id', 'or.id') THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS site FROM l""")
def url_site_of(spark, d):
    host = S.host_of(F.col("url"))
    return table(spark, d, "pages").select("page_id", host.alias("host"), S.site_of(host).alias("site"))


@query("str_classify", r"SELECT page_id, CASE WHEN h IN ('spam-farm.example.org') THEN 'listed' WHEN h LIKE '%.net' THEN 'network' WHEN h LIKE '%.org' THEN 'organisation' ELSE 'other' END AS kind FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS h FROM pages)")
def str_classify(spark, d):
    h = S.host_of(F.col("url"))
    return table(spark, d, "pages").select("page_id", F.when(h.isin("spam-farm.example.org"), "listed").when(h.endswith(".net"), "network").when(h.endswith(".org"), "organisation").otherwise("other").alias("kind"))


@query("html_strip", "SELECT page_id, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS n FROM pages")
def html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(F.regexp_replace("html", "<[^>]+>", "")).cast("long").alias("n"))


@query("str_distinct_join", "WITH f AS (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, left(string_agg(event_type, ';' ORDER BY f), 20) AS kinds FROM f GROUP BY 1")
def str_distinct_join(spark, d):
    f = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    ordered = F.sort_array(F.collect_list(F.struct("f", "event_type")))
    return f.groupBy("user_id").agg(F.left(F.array_join(F.transform(ordered, lambda x: x["event_type"]), ";"), F.lit(20)).alias("kinds"))


@query("text_tokenize", "WITH t AS (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS token FROM part) SELECT token, count(*) AS n FROM t GROUP BY 1")
def text_tokenize(spark, d):
    return table(spark, d, "part").select(F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z]+"), F.lit(0))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("edit1", "WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS token FROM part) SELECT a.token AS a, b.token AS b FROM t a JOIN t b ON a.token < b.token AND damerau_levenshtein(a.token, b.token) <= 1")
def edit1(spark, d):
    t = table(spark, d, "part").select(F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z]+"), F.lit(0))).alias("a")).distinct()
    # words one edit or one exchange of neighbours apart agree once one letter is left out of either: an equi-join on these forms
    forms = F.array_distinct(F.concat(F.array("a"), F.transform(F.sequence(F.lit(1), F.length("a")), lambda i: F.concat(F.left("a", i - 1), F.substr("a", i + 1)))))
    f = t.select("a", F.explode(forms).alias("form"))
    return f.join(f.withColumnRenamed("a", "b"), "form").where("a < b").select("a", "b").distinct().where(S.edit1(F.col("a"), F.col("b")))


@query("hash_sha2", "SELECT c_custkey, sha256(c_name) AS h, to_base64(encode(c_mktsegment)) AS b FROM customer")
def hash_sha2(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.sha2("c_name", 256).alias("h"), F.base64(F.encode("c_mktsegment", "utf-8")).alias("b"))


@query("date_parts", "SELECT event_id, year(ts) AS y, month(ts) AS m, dayofyear(ts) AS doy, isodow(ts) - 1 AS wd, hour(ts) AS h FROM events")
def date_parts(spark, d):
    return table(spark, d, "events").select("event_id", F.year("ts").alias("y"), F.month("ts").alias("m"), F.dayofyear("ts").alias("doy"), F.weekday("ts").alias("wd"), F.hour("ts").alias("h"))


@query("date_trunc_periods", "SELECT event_id, CAST(date_trunc('hour', ts) AS VARCHAR) AS h, CAST(date_trunc('week', ts) AS DATE) AS w, CAST(date_trunc('month', ts) AS DATE) AS m, year(ts) || 'Q' || quarter(ts) AS q FROM events")
def date_trunc_periods(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select("event_id", F.date_format(F.date_trunc("hour", ts), "yyyy-MM-dd HH:mm:ss").alias("h"), F.to_date(F.date_trunc("week", ts)).alias("w"), F.to_date(F.date_trunc("month", ts)).alias("m"), F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string")).alias("q"))


@query("date_arith", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 7 AS week, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days, CAST(last_day(o_orderdate) AS DATE) AS eom FROM orders")
def date_arith(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.date_add(day, 7).alias("week"), F.datediff(day, F.to_date(F.lit("1995-01-01"))).cast("long").alias("days"), F.last_day(day).alias("eom"))


@query("hms_to_seconds", "SELECT c_custkey, CAST(s // 3600 AS BIGINT) * 3600 + CAST(s % 3600 AS BIGINT) AS s FROM (SELECT c_custkey, c_custkey * 37 AS s FROM customer)")
def hms_to_seconds(spark, d):
    s = F.col("c_custkey") * 37
    text = F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    return table(spark, d, "customer").select("c_custkey", S.seconds_of(text).alias("s"))


@query("tz_local_day", "SELECT event_id, CAST(ts + INTERVAL 7 HOUR AS DATE) AS local_day FROM events")
def tz_local_day(spark, d):
    return table(spark, d, "events").select("event_id", F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Jakarta")).alias("local_day"))


@query("fiscal_season", "SELECT o_orderkey, year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END AS crop_year, CASE WHEN month(o_orderdate) BETWEEN 6 AND 10 THEN 'dry' ELSE 'wet' END AS season FROM orders")
def fiscal_season(spark, d):
    m = F.month("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", (F.year("o_orderdate") - (m < 7).cast("int")).alias("crop_year"), F.when(m.between(6, 10), "dry").otherwise("wet").alias("season"))


@query("cyclic_encode", "SELECT event_id, round(sin(2 * pi() * dayofyear(ts) / 365.25), 9) AS s, round(cos(2 * pi() * dayofyear(ts) / 365.25), 9) AS c FROM events")
def cyclic_encode(spark, d):
    a = 2 * F.pi() * F.dayofyear("ts") / 365.25
    return table(spark, d, "events").select("event_id", F.round(F.sin(a), 9).alias("s"), F.round(F.cos(a), 9).alias("c"))


@query("circular_diff", "SELECT c_custkey, ((c_custkey * 7 - c_nationkey * 13 + 26) % 52 + 52) % 52 - 26 AS weeks FROM customer")
def circular_diff(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.circular(F.col("c_custkey") * 7, F.col("c_nationkey") * 13, 52).alias("weeks"))


@query("round_modes", "SELECT s_suppkey, round(s_acctbal / 100, 1) AS up, round_even(s_acctbal / 100, 0) AS even, round(s_acctbal * 4) / 4 AS quarter, floor(s_acctbal / 7) AS f, ceil(s_acctbal / 7) AS c FROM supplier")
def round_modes(spark, d):
    x = F.col("s_acctbal")
    return table(spark, d, "supplier").select("s_suppkey", F.round(x / 100, 1).alias("up"), F.rint(x / 100).alias("even"), (F.round(x * 4) / 4).alias("quarter"), F.floor(x / 7).cast("double").alias("f"), F.ceil(x / 7).cast("double").alias("c"))


@query("round_significant", "SELECT o_orderkey, round(o_totalprice, CAST(3 - floor(log10(abs(o_totalprice))) AS INTEGER)) AS v FROM orders WHERE o_totalprice > 0")
def round_significant(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 0").select("o_orderkey", S.significant(F.col("o_totalprice"), 4).alias("v"))


KNOTS = [(0.0, 0.0), (1000.0, 0.2), (5000.0, 0.9), (9000.0, 1.0)]


@query("piecewise_linear", "SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN 0 WHEN c_acctbal <= 1000 THEN 0.2 * c_acctbal / 1000 WHEN c_acctbal <= 5000 THEN 0.2 + 0.7 * (c_acctbal - 1000) / 4000 WHEN c_acctbal <= 9000 THEN 0.9 + 0.1 * (c_acctbal - 5000) / 4000 ELSE 1 END AS ramp FROM customer")
def piecewise_linear(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.ramp(F.col("c_acctbal"), KNOTS).alias("ramp"))


@query("math_logexp", "SELECT event_id, round(ln(1 + value), 9) AS a, round(exp(value / 100) - 1, 9) AS b, round(sqrt(value), 9) AS c, round(sqrt(value * value + 9), 9) AS e FROM events")
def math_logexp(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(F.log1p(v), 9).alias("a"), F.round(F.expm1(v / 100), 9).alias("b"), F.round(F.sqrt(v), 9).alias("c"), F.round(F.hypot(v, F.lit(3.0)), 9).alias("e"))


@query("math_db_codec", "SELECT event_id, CASE WHEN value > 0 THEN round_even(greatest(-32767, least(32767, 1000 * log10(value))), 0) / 100 END AS db FROM events")
def math_db_codec(spark, d):
    return table(spark, d, "events").select("event_id", S.from_code(S.to_code(F.col("value"))).alias("db"))


@query("safe_div", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0 THEN l_discount / l_tax END AS r FROM lineitem")
def safe_div(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.try_divide("l_discount", "l_tax").alias("r"))


PLACES = "SELECT c_custkey AS k, (c_custkey % 1200) / 10.0 - 60 AS lat, (c_custkey * 7 % 3000) / 10.0 - 150 AS lon FROM customer"


def places(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 1200 / 10 - 60).alias("lat"), (F.col("c_custkey") * 7 % 3000 / 10 - 150).alias("lon"))


@query("geo_haversine", f"SELECT k, round(2 * 6371.0088 * asin(sqrt(sin(radians(lat + 6.2) / 2) ** 2 + cos(radians(-6.2)) * cos(radians(lat)) * sin(radians(lon - 106.8) / 2) ** 2)), 6) AS km FROM ({PLACES})")
def geo_haversine(spark, d):
    return places(spark, d).select("k", F.round(S.haversine(F.lit(-6.2), F.lit(106.8), F.col("lat"), F.col("lon")), 6).alias("km"))


@query("geo_bearing", f"SELECT k, round((degrees(atan2(sin(radians(lon - 106.8)) * cos(radians(lat)), cos(radians(-6.2)) * sin(radians(lat)) - sin(radians(-6.2)) * cos(radians(lat)) * cos(radians(lon - 106.8)))) + 360) % 360, 6) AS deg FROM ({PLACES})")
def geo_bearing(spark, d):
    return places(spark, d).select("k", F.round(S.bearing(F.lit(-6.2), F.lit(106.8), F.col("lat"), F.col("lon")), 6).alias("deg"))


@query("geo_cell_key", f"SELECT k, CAST(round_even(lat * 4, 0) AS BIGINT) * 100000 + CAST(round_even(lon * 4, 0) AS BIGINT) + 3600 AS cell, round_even(lat * 4, 0) / 4 AS clat, round_even(lon * 4, 0) / 4 AS clon FROM ({PLACES})")
def geo_cell_key(spark, d):
    cell = S.cell_key(F.col("lat"), F.col("lon"))
    lat, lon = S.cell_place(cell)
    return places(spark, d).select("k", cell.alias("cell"), lat.alias("clat"), lon.alias("clon"))


@query("geo_sector_ring", "SELECT c_custkey, CAST(floor(((c_custkey * 11 % 360) + 22.5) % 360 / 45) AS INTEGER) AS sector, CASE WHEN c_acctbal < 500 THEN 'near' WHEN c_acctbal < 3000 THEN 'mid' ELSE 'far' END AS ring FROM customer")
def geo_sector_ring(spark, d):
    x = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", S.sector(F.col("c_custkey") * 11 % 360).alias("sector"), F.when(x < 500, "near").when(x < 3000, "mid").otherwise("far").alias("ring"))


@query("geo_px_area", f"SELECT k, round((0.25 * 111320) ** 2 * cos(radians(lat)) / 1e4, 6) AS ha FROM ({PLACES})")
def geo_px_area(spark, d):
    return places(spark, d).select("k", F.round(S.pixel_hectares(F.col("lat"), 0.25), 6).alias("ha"))


@query("derive_physics", """WITH w AS (SELECT event_id AS k, value / 2 AS t, value / 4 AS td, value - 20 AS u, 15 - value AS v FROM events)
    SELECT k, round(100 * exp(17.625 * td / (243.04 + td)) / exp(17.625 * t / (243.04 + t)), 6) AS rh, round(0.6108 * (exp(17.27 * t / (t + 237.3)) - exp(17.27 * td / (td + 237.3))), 6) AS vpd,
    round((degrees(atan2(-u, -v)) + 360) % 360, 6) AS wind_from, round(sqrt(u * u + v * v), 6) AS speed FROM w""")
def derive_physics(spark, d):
    w = table(spark, d, "events").select(F.col("event_id").alias("k"), (F.col("value") / 2).alias("t"), (F.col("value") / 4).alias("td"), (F.col("value") - 20).alias("u"), (15 - F.col("value")).alias("v"))
    r = lambda c, n: F.round(c, 6).alias(n)
    t, td, u, v = (F.col(c) for c in ("t", "td", "u", "v"))
    return w.select("k", r(S.relative_humidity(t, td), "rh"), r(S.vapour_deficit(t, td), "vpd"), r(S.wind_from(u, v), "wind_from"), r(F.hypot(u, v), "speed"))


@query("param_sweep", """SELECT s_suppkey, i, n, round((1000 + abs(s_acctbal)) * i * (1 + i) ** n / ((1 + i) ** n - 1), 6) AS yearly, round(1 - 253.15 / (273.15 + n), 9) AS carnot
    FROM supplier CROSS JOIN (VALUES (0.04), (0.08), (0.12)) a(i) CROSS JOIN (VALUES (10), (20), (30)) b(n)""")
def param_sweep(spark, d):
    """What each supplier would pay a year for its sum over rates and terms, and the best efficiency at the same numbers as temperatures."""
    sums = table(spark, d, "supplier").select("s_suppkey", (1000 + F.abs("s_acctbal")).alias("v"))
    grid = sums.withColumn("i", F.explode(F.array(*map(F.lit, (0.04, 0.08, 0.12))))).withColumn("n", F.explode(F.array(*map(F.lit, (10, 20, 30)))))
    return grid.select("s_suppkey", "i", "n", F.round(F.col("v") * S.capital_recovery(F.col("i"), F.col("n")), 6).alias("yearly"), F.round(1 - 253.15 / (273.15 + F.col("n")), 9).alias("carnot"))


@query("array_ops", "SELECT vec_id, embedding[1] AS first, embedding[-1] AS last, list_sum(list_filter(embedding[1:8], lambda x: x > 0)) AS pos, len(embedding) AS n FROM embeddings")
def array_ops(spark, d):
    e = F.col("embedding")
    pos = F.filter(F.slice(e, 1, 8), lambda x: x > 0)
    return table(spark, d, "embeddings").select("vec_id", e[0].alias("first"), F.element_at(e, -1).alias("last"), F.when(F.size(pos) > 0, F.aggregate(pos, F.lit(0.0), lambda a, x: a + x)).alias("pos"), F.size(e).cast("long").alias("n"))


@query("array_topk_abs", """WITH v AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, i) AS k FROM v)
    SELECT vec_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY k) AS top FROM r WHERE k <= 5 GROUP BY 1""")
def array_topk_abs(spark, d):
    pairs = F.transform("embedding", lambda x, i: F.struct((-F.abs(x)).alias("a"), i.alias("i")))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(F.slice(F.array_sort(pairs), 1, 5), lambda p: p["i"].cast("string")), ",").alias("top"))


@query("json_map", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, coalesce(props ->> '$.none', 'default') AS other FROM events")
def json_map(spark, d):
    m = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.try_element_at(m, F.lit("none")), F.lit("default")).alias("other"))


@query("vec_dot_topk", """WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q, vec_id, list_dot_product(e::DOUBLE[], embedding::DOUBLE[]) / (sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS c FROM q CROSS JOIN embeddings WHERE vec_id <> q),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, vec_id) AS k FROM s) SELECT q, vec_id, k, round(c, 6) AS cosine FROM r WHERE k <= 5""")
def vec_dot_topk(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", S.unit(F.col("embedding")).alias("e"))
    # the stated query set: every fiftieth vector, held against all rows
    return nearest_products(e, "vec_id", "e", e.where("vec_id % 50 = 0"), 5).select("q", "vec_id", "k", F.round("s", 6).alias("cosine"))


@query("udf_scalar", "SELECT c_custkey, length(c_name) + c_nationkey AS x FROM customer")
def udf_scalar(spark, d):
    @F.pandas_udf("long")
    def total(name, nation):
        return name.str.len() + nation

    return table(spark, d, "customer").select("c_custkey", total("c_name", "c_nationkey").alias("x"))


@query("udf_map", "SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'DJF' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'MAM' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season FROM orders")
def udf_map(spark, d):
    names = F.array(*(F.lit(n) for n in ("DJF", "MAM", "JJA", "SON")))
    return table(spark, d, "orders").select("o_orderkey", F.element_at(names, (F.floor(F.month("o_orderdate") % 12 / 3) + 1).cast("int")).alias("season"))


@query("udaf_pandas", "SELECT c_nationkey, round(max(c_acctbal) - min(c_acctbal), 6) AS span FROM customer GROUP BY 1")
def udaf_pandas(spark, d):
    @F.pandas_udf("double")
    def span(x: pd.Series) -> float:
        return round(float(x.max() - x.min()), 6)

    return table(spark, d, "customer").groupBy("c_nationkey").agg(span("c_acctbal").alias("span"))


@query("udtf_rows", "SELECT page_id, word FROM (SELECT page_id, unnest(regexp_extract_all(url, '[a-z0-9]+')) AS word FROM pages)")
def udtf_rows(spark, d):
    @F.udtf(returnType="word: string")
    class Words:
        def eval(self, url: str):
            import re

            for w in re.findall("[a-z0-9]+", url):
                yield (w,)

    spark.udtf.register("url_words", Words)
    table(spark, d, "pages").select("page_id", "url").createOrReplaceTempView("page_urls")
    return spark.sql("SELECT page_id, w.word FROM page_urls, LATERAL url_words(url) w")


@query("pii_scan", r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+')) AS mails, len(regexp_extract_all(text, '[0-9]{3}-[0-9]{3}-[0-9]{4}')) AS phones FROM documents")
def pii_scan(spark, d):
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return table(spark, d, "documents").select("doc_id", n("[A-Za-z0-9._]+@[A-Za-z0-9.]+").alias("mails"), n("[0-9]{3}-[0-9]{3}-[0-9]{4}").alias("phones"))


#: A query and what else its words may be called, as (word, names) pairs.
SEARCH, GLOSSARY = "thing eron", {"thing": ["inging"], "eron": ["erin", "haering"]}


def graded(token: str) -> str:
    near = f" WHEN len(list_filter(tokens, lambda x: damerau_levenshtein(x, '{token}') <= 1)) > 0 THEN 0.8" if len(token) >= 5 else ""
    return f"CASE WHEN list_contains(tokens, '{token}') THEN 2.0 WHEN len(list_filter(tokens, lambda x: starts_with(x, '{token}'))) > 0 THEN 1.2{near} WHEN contains(low, '{token}') THEN 0.6 ELSE 0.0 END"


LEXICAL = "WITH t AS (SELECT doc_id, lower(text) AS low, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS tokens FROM documents), s AS (SELECT doc_id, " + ", ".join(
    f"greatest({', '.join(map(graded, [w, *GLOSSARY.get(w, [])]))}) AS {w}" for w in SEARCH.split()
) + ") SELECT doc_id, round(" + " + ".join(SEARCH.split()) + ", 6) AS score FROM s WHERE " + " AND ".join(f"{w} > 0" for w in SEARCH.split())


@query("search_lexical", LEXICAL.replace(") SELECT doc_id, round", " FROM t) SELECT doc_id, round"))
def search_lexical(spark, d):
    return lexical_hits(table(spark, d, "documents"), "doc_id", "text", SEARCH, GLOSSARY)
