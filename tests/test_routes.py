"""Travel times against Dijkstra, panels with gaps against dummy variables, arrays and covers against hand-made results."""

from __future__ import annotations

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import aggregates, estimators, routes
from tidewater.sources import arrays


def cheapest(follow, start, most):
    best, queue = {}, [start]
    while queue:
        cost, node = heapq.heappop(queue)
        if node in best or cost > most:
            continue
        best[node] = cost
        for other, c in follow(node, cost):
            heapq.heappush(queue, (c, other))
    return best


def test_travel_times(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(60), rnd.randrange(60), float(rnd.randint(0, 9))) for _ in range(220)] + [(1, 2, None), (1, 3, -4.0)]
    known = [e for e in edges if e[2] is not None and e[2] >= 0]
    follow = lambda node, cost: [(v, cost + c) for u, v, c in known if u == node]
    got = {(r.source, r.node): r.cost for r in routes.travel_times(spark.createDataFrame(edges, "u int, v int, cost double"), spark.createDataFrame([(k,) for k in (0, 5, 9, 9, 777, None)], "source int"), 15.0).collect()}
    want = {(s, v): c for s in (0, 5, 9, 777) for v, c in cheapest(follow, (0.0, s), 15.0).items()}
    assert got == want and len(want) > 60


@pytest.mark.parametrize("bucket", [7, 1000])
def test_arrivals(spark, bucket):
    rnd = random.Random(7)
    rides = []
    for _ in range(400):
        t = rnd.randint(0, 300)
        rides.append((rnd.randrange(25), rnd.randrange(25), t, t + rnd.randint(0, 40)))
    rides += [(0, 1, None, 5), (0, 1, 90, 80)]
    follow = lambda node, t: [(v, b) for u, v, a, b in rides if u == node and a is not None and t <= a <= b]
    starts = [(0, 10), (3, 120), (4, 299), (None, 3)]
    got = {(r.source, r.node): r.cost for r in routes.arrivals(spark.createDataFrame(rides, "u int, v int, departs int, arrives int"), spark.createDataFrame(starts, "source int, at int"), 250, bucket).collect()}
    want = {(s, v): c for s, at in starts[:3] for v, c in cheapest(follow, (at, s), 250).items()}
    want[4, 4] = 299  # one is where one is
    assert got == want and len(want) > 20


def test_schedule(spark):
    lines = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x"])], "line int, stops array<string>")
    out = routes.schedule(lines, headway=F.lit(10), first=F.lit(100), last=F.lit(125), stops="stops", leg=F.lit(4))
    assert sorted(map(tuple, out.collect())) == [(1, k + 1, j, "abc"[j], "abc"[j + 1], 100 + 10 * k + 4 * j, 104 + 10 * k + 4 * j) for k in range(3) for j in range(2)]


def test_two_way_unbalanced(spark):
    """Gaps, repeats and a null row: equal to least squares on dummy variables."""
    rng = np.random.default_rng(9)
    rows = [(int(u), int(t)) for u in range(12) for t in range(9) if rng.random() < 0.6] + [(3, 4), (3, 4)]
    x = rng.normal(size=len(rows)) + np.array([0.3 * u - 0.2 * t for u, t in rows])
    y = 1.7 * x + np.array([u * 0.5 + (t - 4) ** 2 * 0.1 for u, t in rows]) + rng.normal(size=len(rows))
    data = [(u, t, float(a), float(b)) for (u, t), a, b in zip(rows, x, y, strict=True)]
    got = estimators.two_way_unbalanced(spark.createDataFrame([*data, (1, 1, None, 2.0)], "u int, t int, x double, y double"), "u", "t", "x", "y").first()
    dummies = np.array([[float(u == k) for k in range(12)] + [float(t == k) for k in range(1, 9)] for u, t in rows])
    out = lambda v: v - dummies @ np.linalg.lstsq(dummies, v, rcond=None)[0]
    xt, yt = out(x), out(y)
    beta = (xt @ yt) / (xt @ xt)
    units = np.array([u for u, _ in rows])
    score = np.array([(xt * (yt - beta * xt))[units == k].sum() for k in range(12)])
    assert got.beta == pytest.approx(beta, rel=1e-7) and got.se == pytest.approx(np.sqrt((score**2).sum() / (xt @ xt) ** 2 * 12 / 11), rel=1e-6)
    assert (got.n, got.units) == (len(rows), 12)
    with pytest.raises(ValueError, match="not below"):
        estimators.two_way_unbalanced(spark.createDataFrame(data, "u int, t int, x double, y double"), "u", "t", "x", "y", rounds=1)


def test_arrays(spark):
    cells = [("a", 0, 0, 1.26), ("a", 2, 3, -7.31), ("a", 2, 3, -9.0), ("a", 9, 9, 1.0), ("b", 1, 1, None), ("b", 1, 2, 4.0)]
    packed = arrays.packed_arrays(spark.createDataFrame(cells, "name string, i int, j int, v double"), "name", "i", "j", "v", (3, 4), 0.5, 1.0)
    every = sorted(tuple(r) for r in arrays.array_window(packed, "name").collect())
    assert every == [("a", 0, 0, 1.5), ("a", 2, 3, -7.5), ("b", 1, 2, 4.0)]
    assert [tuple(r) for r in arrays.array_window(packed, "name", rows=(1, 3), columns=(3, 9)).collect()] == [("a", 2, 3, -7.5)]


def slow_cover(members, floor, target, cap, least, near):
    """One pick after the other, as the rule reads."""
    items = {i for _, i, _ in members}
    of = {s: {i for t, i, _ in members if t == s} for s, _, _ in members}
    dates = {s: len({d for t, _, d in members if t == s}) for s in of}
    ranked = sorted(of, key=lambda s: (-len(of[s]), -dates[s], s))
    chosen, union = [], set()
    for s in ranked:
        if len(of[s]) / len(items) < floor and chosen:
            continue
        chosen.append(s)
        union |= of[s]
        if len(union) / len(items) >= target or len(chosen) >= cap:
            break
    for s in sorted(ranked, key=lambda s: (-dates[s], -len(of[s]), s)):
        if len(chosen) >= least or len(chosen) >= cap:
            break
        if s not in chosen and len(of[s]) / len(items) >= near:
            chosen.append(s)
    union, out = set(), []
    for k, s in enumerate(chosen):
        union |= of[s]
        out.append((k + 1, s, dates[s], round(len(union) / len(items), 9)))
    return out


@pytest.mark.parametrize("rule", [(0.1, 0.9, 4, 2, 0.3), (0.5, 0.99, 5, 5, 0.1), (0.9, 0.2, 3, 3, 0.0), (0.0, 1.0, 2, 9, 0.0), (0.0, 0.3, 6, 4, 0.2)])
def test_cover_sets(spark, rule):
    rnd = random.Random(str(rule))
    members = [(s, rnd.randrange(30), rnd.randrange(s + 2)) for s in range(9) for _ in range(rnd.randint(1, 25))]
    floor, target, cap, least, near = rule
    out = aggregates.cover_sets(spark.createDataFrame([*members, (None, 1, 1)], "s int, i int, d int"), "s", "i", "d", floor, target, cap, least, near)
    assert sorted((r.pick, r.s, r.dates, round(r.covered, 9)) for r in out.collect()) == slow_cover(members, *rule)
