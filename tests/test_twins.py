"""Queries without SQL against plain Python and NumPy on the same rows."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from support import DATA

from tidewater.operators import estimators
from tidewater.plans import registry
from tidewater.plans.analysing import brand_holders
from tidewater.plans.windowing import daily, panel


def test_harmonic_fit(spark):
    series = defaultdict(list)
    for r in panel(spark, DATA).collect():
        series[r.k].append((r.day, r.n))
    got = {r.k: (r.trend, r.amplitude) for r in registry.QUERIES["harmonic_fit"](spark, DATA).collect()}
    assert got.keys() == series.keys()
    for k, rows in series.items():
        first = min(rows)[0]
        t = np.array([(day - first).days for day, _ in rows], float)
        x = np.stack([np.ones_like(t), t, np.sin(2 * np.pi * t / 7), np.cos(2 * np.pi * t / 7)], axis=1)
        beta = np.linalg.solve(x.T @ x, x.T @ np.array([n for _, n in rows], float))
        assert got[k] == pytest.approx((beta[1], np.hypot(beta[2], beta[3])), rel=1e-6, abs=1e-8)


def test_max_spanning_tree(spark):
    edges = [(r.a, r.b, r.phi) for r in registry.QUERIES["proximity_phi"](spark, DATA).collect()]
    label = {x: x for e in edges for x in e[:2]}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    total = 0.0
    for a, b, w in sorted(edges, key=lambda e: -e[2]):
        if root(a) != root(b):
            label[root(a)] = root(b)
            total += w
    tree = registry.QUERIES["max_spanning_tree"](spark, DATA).collect()
    assert len(tree) == len(label) - len({root(x) for x in label})
    assert sum(r[2] for r in tree) == pytest.approx(total)


def test_greedy_cover(spark):
    sets = defaultdict(set)
    for r in brand_holders(spark, DATA).collect():
        sets[r.p_brand].add(r.c_nationkey)
    left, want = set.union(*sets.values()), []
    while left:
        n, name = min((-len(s & left), b) for b, s in sets.items())
        want.append((len(want) + 1, name, -n))
        left -= sets[name]
    assert [tuple(r) for r in registry.QUERIES["greedy_cover"](spark, DATA).orderBy("pick").collect()] == want


def test_eci(spark):
    has = brand_holders(spark, DATA).collect()
    c, p = sorted({r.c_nationkey for r in has}), sorted({r.p_brand for r in has})
    m = np.zeros((len(c), len(p)))
    for r in has:
        m[c.index(r.c_nationkey), p.index(r.p_brand)] = 1
    kc, kp = m.sum(1), m.sum(0)
    values, vectors = np.linalg.eig((m / kc[:, None] / kp) @ m.T)
    second = vectors[:, np.argsort(-values.real)[1]].real
    got = {r.c: r.eci for r in registry.QUERIES["eci"](spark, DATA).collect()}
    assert got.keys() == set(c)
    gap = np.sort(values.real)[::-1]
    if gap[2] / gap[1] < 0.7:  # twelve steps of the iteration tell the second from the third
        assert abs(np.corrcoef(second, [got[k] for k in c])[0, 1]) > 0.95


def test_bootstrap(spark):
    days = defaultdict(lambda: [0, 0])
    for r in daily(spark, DATA).collect():
        days[r.day][0] += r.n
        days[r.day][1] += 1
    s, n = np.array(list(days.values()), float).T
    rng = np.random.default_rng(1)
    means = []
    for _ in range(4000):
        w = rng.poisson(1, len(s))
        means.append((s * w).sum() / (n * w).sum())
    low, median, high = np.quantile(means, [0.025, 0.5, 0.975])
    got = registry.QUERIES["bootstrap_blocks"](spark, DATA).first()
    spread = high - low
    assert abs(got.low - low) < 0.25 * spread and abs(got.median - median) < 0.15 * spread and abs(got.high - high) < 0.25 * spread


def test_isotonic(spark):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").collect()
    sums = defaultdict(lambda: [0.0, 0])
    for r in lines:
        sums[r.l_quantity][0] += r.l_returnflag == "R"
        sums[r.l_quantity][1] += 1
    blocks = []  # pool adjacent violators
    for x in sorted(sums):
        blocks.append([*sums[x], [x]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + xs]
    want = {x: s / n for s, n, xs in blocks for x in xs}
    got = sorted(r.prediction for r in registry.QUERIES["ml_isotonic"](spark, DATA).collect())
    assert got == pytest.approx(sorted(want[r.l_quantity] for r in lines))  # keys of lines repeat, so values are held as a bag


def test_boosting(spark):
    """Prices depend on nothing here, so predictions stay near the mean."""
    rows = registry.QUERIES["ml_gbt"](spark, DATA).collect()
    y, p = np.array([[r.label, r.prediction] for r in rows]).T
    assert len(rows) and p.min() >= y.min() and p.max() <= y.max() and abs(p.mean() - y.mean()) < 0.1 * y.mean()


def test_raked_against_passes(spark):
    """The closed form against up to 200 passes of scaling what is below the top."""
    rng = np.random.default_rng(2)
    rows = [(int(g), k, float(rng.uniform(0, 100)), float(rng.integers(1, 6))) for k, g in enumerate(rng.integers(0, 4, 200))]
    official = {0: 20.0, 1: 55.0, 2: 80.0, 3: 97.0}
    out = estimators.raked(spark.createDataFrame(rows, "g int, k int, p double, w double"), spark.createDataFrame(list(official.items()), "g int, official double"), "g", "k", "p", "w", 100.0)
    got = {r.k: r.rate for r in out.collect()}
    for g, target in official.items():
        own = [r for r in rows if r[0] == g]
        p, w = np.array([r[2] for r in own]), np.array([r[3] for r in own])
        est = np.minimum(100, p * target * w.sum() / (w * p).sum())
        for _ in range(200):
            free = est < 100 - 1e-12
            est[free] = np.minimum(100, est[free] * (1 + (target * w.sum() - (w * est).sum()) / (w[free] * est[free]).sum()))
        assert [got[r[1]] for r in own] == pytest.approx(est.tolist(), abs=1e-6)


def test_upserts(spark, tmp_path):
    """A day over two batches keeps both; batches that run twice, a refetch, and a replay in other batches change nothing; a corrected row replaces its like."""
    from tidewater.streaming import jobs

    path = f"{tmp_path}/days"
    e = spark.sql("SELECT id, 1 AS v, timestamp'2024-01-05 20:00:00' + make_interval(0, 0, 0, 0, cast(id AS int)) AS ts FROM range(8)")
    kept = lambda: sorted((r.id, r.v, str(r.day)) for r in spark.read.parquet(path).collect())
    want = [(k, 1, "2024-01-05" if k < 4 else "2024-01-06") for k in range(8)]
    for batch in (0, 1, 1, 0):
        jobs.upsert_days(e.where(f"id % 2 = {batch}"), path, ["id"])
    assert kept() == want
    jobs.upsert_days(e, path, ["id"])
    for part in ("id < 3", "id >= 3"):
        jobs.upsert_days(e.where(part), path, ["id"])
    assert kept() == want
    jobs.upsert_days(e.where("id = 5").unionByName(e.where("id = 5")).withColumn("v", F.lit(7)), path, ["id"])
    assert kept() == [(k, 7 if k == 5 else v, d) for k, v, d in want]


def test_late_rows(spark, tmp_path):
    """A late file is set apart and counted, and a refetch changes exactly its windows."""
    from tidewater.streaming import jobs

    path = f"{tmp_path}/kept"
    at = lambda first, n, hours: spark.range(first, first + n).select("id", F.expr(f"timestamp'2024-01-01 00:30:00' + make_interval(0, 0, 0, 0, cast((id - {first}) % 3 + {hours} AS int))").alias("ts"))
    early, new, late = at(0, 6, 0), at(100, 6, 200), at(200, 4, 1)
    for k, batch in enumerate((early, new, late.unionByName(at(300, 2, 199)), late.unionByName(at(300, 2, 199)))):
        jobs.keep_late(batch, min(k, 2), path, "1 hour", ["id"])  # the last batch runs twice
    ids = lambda: sorted(r.id for r in spark.read.parquet(f"{path}/days").collect())
    assert ids() == [*range(6), *range(100, 106), 300, 301]
    ledger = sorted((r.batch, r.n, r.n_late) for r in spark.read.parquet(f"{path}/ledger").collect())
    assert ledger == [(0, 6, 0), (1, 6, 0), (2, 6, 4)]
    assert sorted((r.window_start.hour, r.n) for r in jobs.late_windows(spark, path).collect()) == [(1, 2), (2, 1), (3, 1)]
    asked = early.unionByName(new).unionByName(late).unionByName(at(400, 1, 50))
    for _ in range(2):
        jobs.refetch(asked, path, "1 hour", ["id"])
    assert ids() == [*range(6), *range(100, 106), *range(200, 204), 300, 301]
