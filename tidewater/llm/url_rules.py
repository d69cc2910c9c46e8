"""URL filters as a sort-merge range join.

A host becomes the key of its reversed labels, each closed by a separator, so a rule's host covers
one interval of keys: its own host and all subdomains. Pages and rules are dealt by key range,
sorted together, and swept once; a stack holds the rules whose intervals are open, nested by host,
and the page takes the longest one whose path its own path starts with.

Ranges come from a bounded sample of keys (SAMPLE_PER_RANGE keys a range, lowest hashes first, so
it is the same each run). A key that fills several ranges, as a host with a third of all pages
does, is dealt over all of them by page; a rule goes to every range that its interval touches,
which is at most one more copy for each range and nesting depth. So no task gets a whole hot host,
and no rule set is broadcast.

Edge cases: a null url or one without "://" has empty host and path, and only rules with an empty
host fit it; such a rule fits every host; of rules of equal length a block wins; repeated pages are judged
one by one; an empty rule table gives every page the default; empty pages give no rows; other
columns of either table are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = "\x01"
LAST = "\U0010ffff"
SAMPLE_PER_RANGE = 20


def url_parts(url):
    """Host and path columns of a url column."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring_index(F.regexp_replace(url, r"^(?s:.*?)://", ""), "#", 1)).otherwise("")
    rest = F.coalesce(F.substring_index(rest, "?", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, UPPER, LOWER), F.substring(rest, F.char_length(host) + 1, 1 << 30)


def host_key(host):
    """Reversed labels, each closed by the separator: a rule's key is a prefix of the keys of the hosts it fits."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), SEPARATOR), F.lit(SEPARATOR)))


def range_bounds(keyed: DataFrame, ranges: int) -> list[str]:
    """Keys that split the table into about even ranges; a very common key may come several times."""
    least = keyed.select("key", F.xxhash64("key", "page_id", "path").alias("h")).orderBy("h", "key").limit(SAMPLE_PER_RANGE * ranges)
    keys = sorted(r.key for r in least.select("key").collect())
    return [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []


def sweep(batches: Iterator[pd.DataFrame], default: str) -> Iterator[pd.DataFrame]:
    """Over rows sorted by range, key and kind (rules first): each page with its rule and verdict."""
    at, stack = None, []  # of (key, {path: (length, rule, verdict)})
    for batch in batches:
        out = []
        for rng, key, kind, page_id, host, path, verdict in zip(
            batch["rng"], batch["key"], batch["kind"], batch["page_id"], batch["host"], batch["path"], batch["verdict"], strict=True
        ):
            if rng != at:
                at, stack = rng, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}))
                paths = stack[-1][1]
                if paths.get(path, ("", "", ""))[2] != "block":
                    paths[path] = (len(host) + len(path), host + path, verdict)
                continue
            best = (-1, None, default)
            for _, paths in stack:
                for start in paths if len(paths) <= len(path) else (path[:n] for n in range(len(path) + 1)):
                    if path.startswith(start) and start in paths and (paths[start][0], paths[start][2] == "block") > (best[0], best[2] == "block"):
                        best = paths[start]
            out.append((page_id, host, path, best[1], best[2]))
        yield pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"])


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; rules: host, path, verdict."""
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = url_parts(F.col("url"))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    keyed = keyed.select("page_id", "host", "path", host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("verdict"))
    bounds = range_bounds(keyed, ranges)

    @F.pandas_udf("int")
    def page_range(key: pd.Series, salt: pd.Series) -> pd.Series:
        first = pd.Series([bisect_left(bounds, k) for k in key])
        last = pd.Series([bisect_right(bounds, k) for k in key])
        return first + salt % (last - first + 1)

    @F.pandas_udf("array<int>")
    def rule_ranges(key: pd.Series) -> pd.Series:
        return pd.Series([list(range(bisect_left(bounds, k), bisect_right(bounds, k + LAST) + 1)) for k in key])

    dealt = keyed.withColumn("rng", page_range("key", F.pmod(F.xxhash64("page_id", "path"), F.lit(1 << 20))))
    rule = rules.select(
        F.lit(None).cast("long").alias("page_id"),
        F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        F.col("verdict"),
    ).select("page_id", "host", "path", host_key(F.col("host")).alias("key"), F.lit(0).alias("kind"), "verdict")
    rule = rule.withColumn("rng", F.explode(rule_ranges("key")))
    both = dealt.unionByName(rule).repartition(ranges, "rng").sortWithinPartitions("rng", "key", "kind")
    return both.mapInPandas(lambda b: sweep(b, default), "page_id long, host string, path string, rule string, verdict string")
