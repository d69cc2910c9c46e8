"""Joins against brute force on small tables."""

from __future__ import annotations

import random

import pytest

from tidewater.operators import joins


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_best_match(spark):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 18))) for _ in range(60)]

    def bent(w):
        w = list(w)
        for _ in range(rnd.randint(0, max(1, len(w) // 4))):
            k = rnd.randrange(len(w) + 1)
            w[k : k + rnd.randint(0, 1)] = rnd.choice([[], [rnd.choice("abcd")]])
        return "".join(w)

    a, b = sorted(set(base)), sorted({bent(w) for w in base} | {""})
    got = {(r.a, r.b, round(r.ratio, 9)) for r in joins.best_match(spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string"), "a", "b").collect()}
    want = set()
    for x in a:
        best = min(((-(1 - edits(x, y) / max(len(x), len(y))), y) for y in b), default=None)
        if -best[0] >= 0.8 - 1e-12:
            want.add((x, best[1], round(-best[0], 9)))
    assert got == want and len(want) > 20


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_nearest_value(spark, monkeypatch, ranges):
    monkeypatch.setattr(joins, "RANGES", ranges)
    rnd = random.Random(4)
    left = [(k % 3, rnd.randint(0, 50) / 2, k) for k in range(40)]
    right = list({(g, x): (g, x, 100 + k) for k, (g, x) in enumerate((rnd.randint(0, 1), rnd.randint(0, 50) / 2) for _ in range(30))}.values())
    out = joins.nearest_value(spark.createDataFrame(left, "g int, x double, id int"), spark.createDataFrame(right, "g int, x double, key int"), "g", "x", "key").collect()
    want = {}
    for g, x, i in left:
        near = [(abs(x - y), key) for h, y, key in right if h == g]
        if near:
            want[i] = min(near)
    assert {r.id: (r.gap, r.key) for r in out} == want


def test_in_polygons(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(5)
    rings = {1: [(0, 0), (10, 0), (10, 10), (0, 10)], 2: [(5, 5), (15, 6), (9, 9), (14, 15)], 3: [(-5, -5), (-1, -5), (-3, -1)]}
    points = [(k, rnd.uniform(-6, 16), rnd.uniform(-6, 16)) for k in range(300)]

    def inside(x, y, ring):
        n = 0
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if min(y1, y2) <= y < max(y1, y2) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                n += 1
        return n % 2 == 1

    zones = spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in ring]) for k, ring in rings.items()], "zone int, ring array<struct<x: double, y: double>>")
    got = {(r.id, r.zone) for r in joins.in_polygons(spark.createDataFrame(points, "id int, px double, py double").select("id", F.col("px").alias("x"), F.col("py").alias("y")), zones, "x", "y", "ring", 4.0).collect()}
    assert got == {(k, z) for k, x, y in points for z, ring in rings.items() if inside(x, y, ring)} and got
