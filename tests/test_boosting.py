"""Boosting against a NumPy twin, its losses on held-out rows, and Shapley values against their definition."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from tidewater.operators import boosting as B

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    x = np.stack([rng.uniform(0, 10, 1500), rng.integers(0, 5, 1500), rng.normal(size=1500)], axis=1)
    y = 3 * (x[:, 0] > 4) + x[:, 1] * (x[:, 2] > 0) + rng.exponential(1 + (x[:, 0] > 7) * 3)
    return x, y, (rng.random(1500) < 1 / (1 + np.exp(2 - y / 2))).astype(float)


@pytest.fixture(scope="module")
def frame(spark, rows):
    x, y, z = rows
    data = [(k, *map(float, x[k]), float(y[k]), float(z[k]), k % 4 == 0) for k in range(len(y))]
    return spark.createDataFrame([*data, (9999, 1.0, None, 1.0, None, None, False)], "id int, a double, b double, c double, y double, z double, held_out boolean")


def bins_of(x, edges):
    return np.stack([sum((x[:, k] > e).astype(int) for e in edges[k]) + np.zeros(len(x), int) for k in range(x.shape[1])], axis=1)


def leaf(tree, bins):
    out = np.ones(len(bins), int)
    for _ in range(9):
        for k in np.unique(out):
            if k in tree.splits:
                f, most = tree.splits[k]
                own = out == k
                out[own] = 2 * k + (bins[own, f] > most)
    return out


def twin(x, y, edges, loss, q, trees, depth=3, rate=0.2, least=20, ridge=1.0):
    bins = bins_of(x, edges)
    start = np.quantile(y, q) if loss == "quantile" else y.mean()
    if loss == "logistic":
        start = math.log(start / (1 - start))
    m, out = np.full(len(y), start), []
    for _ in range(trees):
        if loss == "quantile":
            g, h = np.where(y > m, q, q - 1), np.ones(len(y))
        elif loss == "logistic":
            p = 1 / (1 + np.exp(-m))
            g, h = y - p, p * (1 - p)
        else:
            g, h = y - m, np.ones(len(y))
        tree, level = B.Tree(), {1}
        for d in range(depth + 1):
            at, following = leaf(tree, bins), set()
            for k in sorted(level):
                own = at == k
                score = lambda s: g[s].sum() ** 2 / (h[s].sum() + ridge)
                tree.values[k] = g[own].sum() / (h[own].sum() + ridge)
                best = (0.0, None)
                for f, b in itertools.product(range(x.shape[1]), range(B.BINS - 1)):
                    left, right = own & (bins[:, f] <= b), own & (bins[:, f] > b)
                    if d < depth and min(left.sum(), right.sum()) >= least:
                        gain = score(left) + score(right) - score(own)
                        if gain > best[0] + 1e-7:
                            best = (gain, (f, b))
                if best[1]:
                    tree.splits[k] = best[1]
                    following |= {2 * k, 2 * k + 1}
            level = following
        at = leaf(tree, bins)
        if loss == "quantile":
            for k in np.unique(at):
                tree.values[k] = np.quantile((y - m)[at == k], q)
        m = m + rate * np.array([tree.values[k] for k in at])
        out.append(tree)
    return out, m


@pytest.mark.parametrize("loss", ["squared", "quantile", "logistic"])
def test_against_twin(frame, rows, monkeypatch, loss):
    monkeypatch.setattr(B, "CUT", 2)
    x, y, z = rows
    target = z if loss == "logistic" else y
    forest = B.fit(frame, FEATURES, "z" if loss == "logistic" else "y", loss=loss, quantile=0.8, trees=3)
    trees, m = twin(x, target, forest.edges, loss, 0.8, 3)
    assert [t.splits for t in forest.trees] == [t.splits for t in trees]
    got = {r.id: r.prediction for r in B.predicted(frame, forest).collect()}
    want = 1 / (1 + np.exp(-m)) if loss == "logistic" else m
    assert [got[k] for k in range(len(y))] == pytest.approx(want.tolist(), abs=1e-4) and got[9999] is not None


def test_held_out_losses(frame):
    fold = lambda loss, y, q=0.5: B.predicted(frame.where("held_out"), B.fit(frame.where("NOT held_out"), FEATURES, y, loss=loss, quantile=q, trees=8)).toPandas()
    pinball = lambda y, p, q: np.maximum(q * (y - p), (q - 1) * (y - p)).mean()
    p = fold("quantile", "y", 0.9)
    constant = frame.where("NOT held_out AND y IS NOT NULL").toPandas()["y"].quantile(0.9)
    assert pinball(p["y"], p["prediction"], 0.9) < 0.8 * pinball(p["y"], constant, 0.9)
    assert 0.8 < (p["y"] <= p["prediction"]).mean() < 0.97
    p = fold("logistic", "z")
    entropy = lambda q: -(p["z"] * np.log(q) + (1 - p["z"]) * np.log(1 - q)).mean()
    assert entropy(p["prediction"]) < 0.95 * entropy(p["z"].mean()) and p["prediction"].between(0, 1).all()


def test_shapley(spark, frame, rows):
    x, _, _ = rows
    forest = B.fit(frame, FEATURES, "y", trees=3)
    bins = bins_of(x[:20], forest.edges)
    got = B.shapley(forest, bins)
    worth = lambda s: sum(forest.rate * B.expected(t, bins, frozenset(s)) for t in forest.trees)
    for f in range(3):
        others = [k for k in range(3) if k != f]
        want = sum(math.factorial(n) * math.factorial(2 - n) / 6 * (worth({*s, f}) - worth(s)) for n in range(3) for s in itertools.combinations(others, n))
        assert got[:, f] == pytest.approx(want)
    out = B.shap_values(frame, forest, ["id"])
    prediction = {r.id: r.prediction for r in B.predicted(frame, forest).collect()}
    assert all(r.margin == pytest.approx(prediction[r.id]) for r in out.collect())
    shares = {r.family: r.share for r in B.family_shares(out, {"both": ["a", "b"], "c": ["c"]}).collect()}
    assert sum(shares.values()) == pytest.approx(1) and shares["both"] > shares["c"]
    gains = {r.feature: r.gain for r in B.permutation_importance(frame.where("y IS NOT NULL"), forest, "y", "id").collect()}
    assert gains["a"] > 0.5 and gains["b"] > 0
    moved = B.permuted(frame, "a", "id", deals=5)
    assert sorted(r.a for r in moved.collect()) == sorted(r.a for r in frame.collect())


def test_odd_rows(spark):
    none = spark.createDataFrame([], "a double, b double, c double, y double")
    assert B.predicted(none, B.fit(none, FEATURES, "y", trees=2)).count() == 0
    same = spark.createDataFrame([(1.0, None, 2.0, 5.0)] * 50, "a double, b double, c double, y double")
    assert {r.prediction for r in B.predicted(same, B.fit(same, FEATURES, "y", trees=2)).collect()} == {5.0}
