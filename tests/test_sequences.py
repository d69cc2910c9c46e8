"""The convolutional classifier's gradients and held-out figures; lines as texts; spaced picks; odd vectors in searches."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tidewater.functions import lines
from tidewater.operators import search, sequences, windows


def test_gradients():
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=(6, 9, 1)), np.array([0, 1, 2, 1, 0, 2]), rng.uniform(0.5, 2, 6)
    p = sequences.new_parameters(1, 3)
    g, loss = sequences.gradients(p, x, y, w)
    for name, v in p.items():
        for at in np.ndindex(*v.shape) if v.size < 30 else [tuple(rng.integers(0, s) for s in v.shape) for _ in range(25)]:
            kept = v[at]
            both = []
            for step in (1e-6, -1e-6):
                v[at] = kept + step
                both.append(sequences.gradients(p, x, y, w)[1])
            v[at] = kept
            assert (both[0] - both[1]) / 2e-6 == pytest.approx(g[name][at], abs=1e-4)
    assert loss > 0


def test_held_out(spark):
    """Where a bump stands in noise tells the class; a fit repeats exactly, whatever the partitions."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(300):
        label = k % 2
        x = rng.normal(0, 0.5, 20)
        at = rng.integers(0, 14)
        x[at : at + 6] += np.linspace(0, 3, 6) if label else np.linspace(3, 0, 6)  # a rise or a fall
        rows.append((k, [float(v) for v in x], label))
    rows += [(1000, None, 1), (1001, [1.0, None], None), (1002, [], 7)]
    df = spark.createDataFrame(rows, "id int, series array<double>, label int")
    train = df.where("id % 3 <> 0 AND id < 300")
    p, losses = sequences.fit(train.repartition(3), "series", "label", 20, 2, epochs=25)
    again, _ = sequences.fit(train.repartition(2, "id"), "series", "label", 20, 2, epochs=2)
    twice, _ = sequences.fit(train.repartition(5), "series", "label", 20, 2, epochs=2)
    assert all(np.allclose(again[k], twice[k], atol=1e-6) for k in again)
    out = sequences.classified(df.where("id % 3 = 0 AND id < 300"), p, "series", 20, ["id", "label"]).toPandas()
    assert losses[-1] < 0.6 * losses[0] and (out["label"] == out["predicted"]).mean() > 0.85
    assert sequences.classified(df.where("id >= 300"), p, "series", 20, ["id"]).count() == 3
    none, losses = sequences.fit(df.limit(0), "series", "label", 20, 2)
    assert losses == [] and none["out"].shape == (16, 2)


def test_lines(spark):
    known = [(-120.2, 38.5), (-120.95, 40.7), (-126.453, 43.252)]
    rnd = random.Random(4)
    rows = [(0, known), (1, [(0.0, 0.0)]), (2, []), (3, None), (4, [(rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for _ in range(40)]), (5, [(1e9, -1e9), (1e9, -1e9)])]
    df = spark.createDataFrame([(k, None if v is None else [{"x": x, "y": y} for x, y in v]) for k, v in rows], "id int, line array<struct<x: double, y: double>>")
    texts = df.select("id", lines.encoded("line").alias("text")).cache()
    assert {r.id: r.text for r in texts.collect()}[0] == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    back = {r.id: r.line for r in texts.select("id", lines.decoded("text").alias("line")).collect()}
    for k, v in rows:
        assert back[k] is None if v is None else [(c.x, c.y) for c in back[k]] == [(round(x, 5), round(y, 5)) for x, y in v]
    texts.unpersist()


def test_spaced(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", None]), rnd.randint(0, 200)) for _ in range(150)] + [("c", None), ("c", 3), ("c", 3)]
    got = sorted(windows.spaced(spark.createDataFrame(rows, "k string, t int"), ["k"], "t", 6).collect(), key=repr)
    want = []
    for key in ("a", "b", "c", None):
        last = None
        for t in sorted(t for k, t in rows if k == key and t is not None):
            if last is None or t - last >= 6:
                want.append((key, t))
                last = t
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [1.0, None]), (5, [1.0]), (None, [9.0, 9.0]), (6, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = sorted((r.q, r.id, r.s, r.k) for r in search.nearest_products(df, "id", "v", df.where("id IN (1, 3)"), 2).collect())
    assert got == [(1, 2, 0.5, 1), (1, 6, 0.0, 2)]
