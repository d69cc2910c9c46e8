"""Searches without SQL, held against brute force on small tables."""

from __future__ import annotations

import random
import re

from support import DATA

from tidewater.plans import registry


def test_search_hybrid(spark, tmp_path):
    rnd = random.Random(1)
    vectors = {k: [rnd.uniform(-1, 1) for _ in range(8)] for k in range(201)}
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.read.parquet(f"{DATA}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()}
    want = {}
    for q in range(0, 201, 50):
        s = sorted(((-round(sum(a * b for a, b in zip(vectors[q], v, strict=True)), 6), k) for k, v in vectors.items() if k != q))[:40]
        for x, k in s:
            if -x >= -s[0][0] - 0.05:
                want[k] = max(want.get(k, -9.0), -x)
    lexical = {r.doc_id: r.score for r in registry.QUERIES["search_lexical"](spark, str(tmp_path)).collect()}
    want = {k: (1, s) for k, s in want.items()} | {k: (0, float(s)) for k, s in lexical.items()}
    rows = registry.QUERIES["search_hybrid"](spark, str(tmp_path)).collect()
    got = {r.hit: (r.kind, r.s) for r in rows}
    assert len(got) == len(rows) and got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-5 for k in want)
    assert sum(kind for kind, _ in got.values()) > 0


def test_edits():
    """The pattern of words an edit away against all words over three letters."""
    from itertools import product

    from tidewater.operators.search import one_edit

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        forms = {a, *(a[:k] + a[k + 1 :] for k in range(len(a))), *(a[:k] + a[k + 1] + a[k] + a[k + 2 :] for k in range(len(a) - 1))}
        forms |= {a[:k] + c + a[k + n :] for k in range(len(a) + 1) for n in (0, 1) for c in "abc"}
        return b in forms

    for token in ("abca", "aabb"):
        for n in (2, 3, 4, 5, 6):
            for word in map("".join, product("abc", repeat=n)):
                assert bool(re.fullmatch(one_edit(token), word)) == near(token, word)


def test_best_products_of_ties_and_nothing(spark):
    from tidewater.operators.search import nearest_products

    rows = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(9)], "id long, v array<double>")
    got = nearest_products(rows, "id", "v", rows.where("id = 4"), 3).collect()
    assert sorted((r.q, r.id, r.s, r.k) for r in got) == [(4, 0, 1.0, 1), (4, 1, 1.0, 2), (4, 2, 1.0, 3)]
    assert nearest_products(rows.limit(0), "id", "v", rows.limit(0), 3).count() == 0
