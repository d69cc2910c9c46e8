"""Searches: words in texts, and vectors by their products, of a stated query set against all rows."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors are held against all rows in blocks of about so many bytes.
BLOCK_BYTES = 8 << 20


def one_edit(token: str) -> str:
    """A pattern of all words one letter put in, left out, changed or exchanged with its neighbour away from the token."""
    forms = {token}
    for k in range(len(token) + 1):
        left, right = re.escape(token[:k]), token[k:]
        forms.add(f"{left}[a-z]{re.escape(right)}")
        if right:
            forms |= {left + re.escape(right[1:]), f"{left}[a-z]{re.escape(right[1:])}"}
        if len(right) > 1:
            forms.add(left + re.escape(right[1] + right[0] + right[2:]))
    return "|".join(sorted(forms))


def grade(low: Column, token: str) -> Column:
    """2 for the word itself, 1.2 for a word that it begins, 0.8 for one an edit away (five letters at least), 0.6 inside the text, else 0."""
    word = re.escape(token)
    out = F.when(F.rlike(low, F.lit(f"(?<![a-z]){word}(?![a-z])")), 2.0)
    if len(token) >= 3:
        out = out.when(F.rlike(low, F.lit(f"(?<![a-z]){word}")), 1.2)
    if len(token) >= 5:
        out = out.when(F.rlike(low, F.lit(f"(?<![a-z])(?:{one_edit(token)})(?![a-z])")), 0.8)
    return out.when(F.contains(low, F.lit(token)), 0.6).otherwise(0.0)


def lexical_hits(docs: DataFrame, key: str, text: str, query: str, glossary: dict[str, list[str]]) -> DataFrame:
    """key and score of the rows that hold every word of the query or one of its other names; a word counts by its best grade. One pass, no shuffle."""
    low = docs.select(key, F.lower(text).alias("_low"))
    words = re.findall("[a-z]+", query.lower())
    grades = [F.greatest(*named, F.lit(0.0)) for w in words if (named := [grade(F.col("_low"), t) for t in (w, *glossary.get(w, []))])]
    scored = low.select(key, *(g.alias(f"_g{k}") for k, g in enumerate(grades)))
    columns = [F.col(f"_g{k}") for k in range(len(grades))]
    return scored.where(reduce(lambda a, b: a & b, (c > 0 for c in columns))).select(key, F.round(reduce(lambda a, b: a + b, columns), 6).alias("score"))


def nearest_products(rows: DataFrame, key: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """q, key, s and rank k of the k rows with the greatest products with each query, itself left out; ties go to the lesser key.

    Vectors that are null, hold nulls, or have fewer dimensions than the longest query have no products; rows without a key have none either.

    The queries are counted and taken in blocks of bounded bytes, each broadcast in turn. A task keeps its own k best for each
    query of the block, so what is shuffled follows queries and tasks and not rows times queries.
    """
    spark = rows.sparkSession
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("dims")).first()
    whole = F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) == (size.dims or 0)) & F.forall(vector, lambda v: v.isNotNull())
    rows, queries = rows.where(whole), queries.where(whole)
    blocks = max(1, math.ceil(size.n * (size.dims or 1) * 8 / BLOCK_BYTES))
    out = None
    for block in range(blocks):
        mine = queries.select(key, vector).where(F.pmod(F.xxhash64(key), F.lit(blocks)) == block).orderBy(key).collect()  # BLOCK_BYTES or so
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in mine], np.int64), np.array([r[1] for r in mine], np.float64)))
        best = rows.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(best_of(shared, key, k), f"q long, `{key}` long, s double")
        out = best if out is None else out.unionByName(best)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), key))
    return out.withColumn("k", rank).where(F.col("k") <= k)


def best_of(shared, name: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, wanted = shared.value
        key = value = None  # of each query, the best so far
        for b in batches:
            if not len(ids) or not b.num_rows:
                continue
            vectors = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            own = b.column(0).to_numpy()
            for a in range(0, len(own), 1024):
                s = wanted @ vectors[a : a + 1024].T
                s[ids[:, None] == own[a : a + 1024]] = -np.inf
                names = np.broadcast_to(own[a : a + 1024], s.shape)
                if key is not None:
                    s, names = np.concatenate([value, s], axis=1), np.concatenate([key, names], axis=1)
                order = np.lexsort((names, -s), axis=1)[:, :k]
                key, value = np.take_along_axis(names, order, axis=1), np.take_along_axis(s, order, axis=1)
        if key is not None:
            seen = np.isfinite(value)
            q = np.broadcast_to(ids[:, None], key.shape)
            yield pa.RecordBatch.from_arrays([pa.array(q[seen]), pa.array(key[seen]), pa.array(value[seen])], names=["q", name, "s"])

    return run
