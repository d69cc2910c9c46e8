"""The queries of the corpus operators, over whole tables, and their SQL where it can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from . import line_rules, quality_knn, toxicity_gru
from .common import shared_dir, table
from .decontaminate import contaminated
from .line_rules import judged
from .parity_join import linked_documents
from .piece_codec import digests
from .sharding import shard_documents
from .spelling_halves import spelling_variants
from .style_tree import main_texts
from .superminhash import near_duplicates
from .token_index import documents_of, read_segments, write_segments
from .url_rules import judge_urls
from .yinyang_codes import vector_codes


def op1_virtual_slot_sharding(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op9_line_first_cleaning(spark, sf_dir):
    return judged(table(spark, sf_dir, "documents"))


def op2_quality_knn(spark, sf_dir):
    return quality_knn.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pigeonhole_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_perfect_hash_index(spark, sf_dir):
    path = f"{shared_dir(spark)}/tidewater/segments-{uuid.uuid4().hex}"
    write_segments(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return documents_of(read_segments(spark, path))


def op5_toxicity_gru(spark, sf_dir):
    return toxicity_gru.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_parity_sketch_join(spark, sf_dir):
    return linked_documents(table(spark, sf_dir, "documents"))


#: Fixed by the query's contract: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op7_url_range_join(spark, sf_dir):
    rules = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in URL_RULES))))
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op8_site_style_tree(spark, sf_dir):
    return main_texts(table(spark, sf_dir, "pages"))


def op10_piece_codec(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_spelling_halves(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_yinyang_codes(spark, sf_dir):
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_superminhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_virtual_slot_sharding,
        op2_quality_knn,
        op3_pigeonhole_decontamination,
        op4_perfect_hash_index,
        op5_toxicity_gru,
        op6_parity_sketch_join,
        op7_url_range_join,
        op8_site_style_tree,
        op9_line_first_cleaning,
        op10_piece_codec,
        op11_spelling_halves,
        op12_yinyang_codes,
        op13_superminhash,
    )
}

def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LINE_RULES_SQL = rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
    grams AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM w, unnest(range(1, greatest(len(words) - 1, 1))) AS t(i)),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) v(o) GROUP BY 1),
    ls AS (SELECT doc_id, unnest(lines) AS l FROM w),
    sizes AS (SELECT doc_id, l, length(l) AS chars, length(l) - length(replace(l, ' ', '')) + 1 AS n,
        {" + ".join(f"length(l) - length(replace(l, {quoted(c)}, ''))" for c in line_rules.SEPARATORS)} AS seps,
        length(l) - length(translate(l, {quoted(line_rules.NOISE)}, '')) AS noise, regexp_replace(l, '[\x20\x09-\x0D]+$', '') AS bare FROM ls),
    judged AS (SELECT doc_id, chars,
        chars <= {line_rules.BOILERPLATE_CHARS} AND ({" OR ".join(f"contains(lower(l), {quoted(x)})" for x in line_rules.BOILERPLATE)})
        OR seps >= 2 AND seps * 4 >= n
        OR noise * 100 > (chars - n + 1) * {line_rules.NOISE_PERCENT}
        OR n BETWEEN {line_rules.UNENDED_WORDS[0]} AND {line_rules.UNENDED_WORDS[1]} AND NOT contains({quoted(line_rules.ENDS)}, right(bare, 1)) AS bad FROM sizes),
    lost AS (SELECT doc_id, count(*) FILTER (WHERE bad) AS n_lines_removed, coalesce(sum(chars) FILTER (WHERE bad), 0) AS chars_removed, sum(chars) AS line_chars FROM judged GROUP BY 1),
    base AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(text) - length(translate(text, {quoted(line_rules.SYMBOLS)}, '')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines,
        coalesce(n_lines_removed, 0) AS n_lines_removed, CAST(coalesce(chars_removed, 0) AS BIGINT) AS chars_removed, CAST(coalesce(line_chars, 0) AS BIGINT) AS line_chars
        FROM w LEFT JOIN covered c USING (doc_id) LEFT JOIN lost USING (doc_id))
    SELECT *, n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > {line_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed,
        NOT (n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > {line_rules.MAX_REPEAT_PERCENT} * n_words) AND chars_removed * 100 <= line_chars * {line_rules.MAX_LOST_PERCENT} AS kept
    FROM base"""


def near_sql(size: int, more: str = "") -> str:
    """Links by the sizes of shared and joined sets of shingles, then all that is reachable."""
    return rf"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, CASE WHEN len(w) < {size} THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + {size - 1}], ' ') END AS s
            FROM words, unnest(range(1, greatest(len(w) - {size - 2}, 2))) AS t(i) WHERE len(w) > 0),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (
            SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
        both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN both_ways l ON l.x = r.node)
        SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id{more}
        FROM documents d LEFT JOIN sizes s USING (doc_id)
        JOIN (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)"""


SPELLING_SQL = r"""
    WITH RECURSIVE step(i, v, k) AS (
        SELECT i, i, 0 FROM range(256) t(i) UNION ALL
        SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM step WHERE k < 8),
    crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8),
    runs AS (
        SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d,
               unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS r FROM documents),
    counted AS (SELECT d, r, count(*) AS c FROM runs WHERE length(r) >= 6 GROUP BY ALL),
    hashed AS (
        SELECT r, c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
            flatten(list_transform(string_split(d || ':' || r, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + (unicode(x) >> 6) AS BIGINT), CAST(128 + (unicode(x) & 63) AS BIGINT)] END))),
            lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) AS h
        FROM counted, crc),
    spelt AS (SELECT CASE WHEN h % 199 = 0 THEN r[:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, c FROM hashed),
    words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
    cut AS MATERIALIZED (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM words, unnest(range(1, length(word) + 1)) t(i)),
    pairs AS (
        SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
        UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
        UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
    best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS form, max(n) AS form_n FROM pairs GROUP BY word),
    forms AS MATERIALIZED (
        SELECT w.word, CASE WHEN form_n >= 5 * w.n THEN form END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n
        FROM words w LEFT JOIN best USING (word)),
    chain(word, node, k) AS (SELECT word, word, 0 FROM forms UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON f.word = c.node WHERE f.form IS NOT NULL)
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(node, k) AS root FROM chain GROUP BY word) USING (word)"""


def codes_sql(rounds: int = 6) -> str:
    """The rounds one after the other, each with all distances."""
    out = """
    WITH kept AS MATERIALIZED (
        SELECT row_number() OVER () AS row, vec_id, label, embedding AS v, len(embedding) // 8 AS w FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS MATERIALIZED (SELECT row, p, list_transform(v[p * w + 1:(p + 1) * w], lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM kept, range(8) t(p)),
    firsts AS (SELECT row, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 16),
    book0 AS MATERIALIZED (SELECT p, e, x AS c FROM firsts JOIN parts USING (row)),"""
    nearest = """
    near{k} AS MATERIALIZED (
        SELECT row, p, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) AS m
        FROM parts JOIN book{k} USING (p) GROUP BY row, p),"""
    for k in range(rounds):
        out += nearest.format(k=k) + f"""
    sums{k} AS (
        SELECT p, m.e AS e, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS c
        FROM near{k} JOIN parts USING (row, p), unnest(range(1, len(x) + 1)) t(i) GROUP BY ALL),
    means{k} AS (SELECT p, e, list(c ORDER BY i) AS c FROM sums{k} GROUP BY ALL),
    book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN means{k} m USING (p, e)),"""
    return out + nearest.format(k=rounds) + f"""
    coded AS MATERIALIZED (SELECT row, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM near{rounds} GROUP BY row),
    every AS MATERIALIZED (SELECT vec_id, label, code, error FROM kept JOIN coded USING (row))
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256 FROM every"""


ORACLE_SQL: dict[str, str] = {
    "op11_spelling_halves": SPELLING_SQL,
    "op12_yinyang_codes": codes_sql(),
    "op13_superminhash": near_sql(2, ", d.doc_id = r.component_id AS kept"),
    "op9_line_first_cleaning": LINE_RULES_SQL,
    "op6_parity_sketch_join": near_sql(5),
    "op7_url_range_join": r"""
        WITH rest AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS r
            FROM pages),
        parts AS (
            SELECT page_id, translate(regexp_extract(r, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   substr(coalesce(r, ''), length(regexp_extract(coalesce(r, ''), '^[^/]*')) + 1) AS path
            FROM rest),
        rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        fits AS (
            SELECT page_id, host, path, h || p AS rule, v,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS k
            FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT a.page_id, coalesce(a.host, '') AS host, a.path, f.rule, coalesce(f.v, 'allow') AS verdict
        FROM parts a LEFT JOIN fits f ON f.page_id = a.page_id AND f.k = 1""",
}
