"""What larger and odd tables brought to light: rounding, ties, tables without spread, and steps that must not gather a group in a task."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from support import DATA, same

from tidewater.operators import aggregates as A
from tidewater.operators import boosting, estimators
from tidewater.operators import joins as J
from tidewater.operators import stats as S
from tidewater.plans import registry


def test_eci_without_spread(spark, tmp_path):
    """All nations hold all brands: no brand tells them apart."""
    d = str(tmp_path)
    spark.range(3).select(F.col("id").alias("c_custkey"), F.col("id").cast("int").alias("c_nationkey")).write.parquet(f"{d}/customer.parquet")
    spark.range(3).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey")).write.parquet(f"{d}/orders.parquet")
    spark.range(2).select(F.col("id").alias("p_partkey"), F.concat(F.lit("b"), "id").alias("p_brand")).write.parquet(f"{d}/part.parquet")
    spark.range(6).select((F.col("id") % 3).alias("l_orderkey"), (F.col("id") % 2).alias("l_partkey"), F.lit(50.0).alias("l_quantity")).write.parquet(f"{d}/lineitem.parquet")
    assert sorted((r.c, r.eci) for r in registry.QUERIES["eci"](spark, d).collect()) == [(0, 0.0), (1, 0.0), (2, 0.0)]


def test_quantize_in_single_floats(spark, duck, tmp_path):
    """0.35106301 of 0.37 is 120 in single floats and 121 in doubles."""
    d = str(tmp_path)
    rows = [(1, [0.3510630130767822, -0.37, 0.0]), (2, [1.0, 0.5, None]), (3, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    sql = registry.ORACLES["vec_quantize_int8"].replace("FROM embeddings", f"FROM '{d}/embeddings.parquet/*.parquet'")
    got, want = same(registry.QUERIES["vec_quantize_int8"](spark, d), duck, sql)
    assert got == want and [0.0, 120.0, 1.0] in got[1]


def test_raked_with_rates_of_zero(spark):
    """Once only rates of 0 are left, the rest of the sums is rounding alone and must not make a factor."""
    rng = np.random.default_rng(5)
    rows = [(g, g * 1000 + k, 0.0 if k < 3 else float(rng.integers(1, 9999)) / 100, float(rng.integers(1, 6))) for g in range(20) for k in range(400)]
    official = [(g, 60.0) for g in range(20)]
    out = estimators.raked(spark.createDataFrame(rows, "g int, k int, p double, w double"), spark.createDataFrame(official, "g int, official double"), "g", "k", "p", "w", 100.0)
    mean = out.groupBy("g").agg((F.sum(F.col("rate") * F.col("w")) / F.sum("w")).alias("m")).collect()
    assert [r.m for r in mean] == pytest.approx([60.0] * 20)


def test_quantiles_without_a_group_in_one_task(spark):
    """Brackets and counts give what percentile gives, ties and few rows included."""
    rng = np.random.default_rng(6)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 4000), rng.integers(0, 900, 4000))] + [(7, 1.0), (8, 2.0), (8, 3.0), (9, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    for q, accuracy in ((0.9, 50), (0.5, 10_000), (1.0, 100)):
        want = {r.g: r.v for r in df.where("v IS NOT NULL").groupBy("g").agg(F.percentile("v", q).alias("v")).collect()}
        assert boosting.quantiles(df, "g", "v", q, accuracy) == pytest.approx(want)


def test_shapley_by_cells():
    """Values looked up by cells are those of the definition."""
    rng = np.random.default_rng(7)
    trees = [boosting.Tree({1: (0, 5), 2: (1, 3), 3: (0, 9)}, {4: 1.0, 5: 2.0, 6: -3.0, 7: 4.0}, {2: 30, 3: 20, 4: 10, 5: 20, 6: 15, 7: 5}), boosting.Tree({}, {1: 2.0}, {1: 50})]
    forest = boosting.Forest(["a", "b", "c"], [[]] * 3, "squared", 0.5, 0.2, 1.0, trees)
    bins = rng.integers(0, 12, (200, 3))
    assert boosting.looked_up(boosting.shapley_tables(forest), list(bins.T)) == pytest.approx(boosting.shapley(forest, bins))


def test_sums_within_without_pairs(spark):
    """Counts and sums in circles against all pairs, points on the edge and repeated ones included; the plan joins nothing."""
    rng = np.random.default_rng(8)
    a = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.integers(-20, 20, (60, 2)))] + [(99, None, 1.0)]
    b = [(float(x), float(y)) for x, y in rng.integers(-40, 40, (500, 2)) / 2] + [(1.0, None)]
    out = J.sums_within(spark.createDataFrame(a, "k int, ax double, ay double"), spark.createDataFrame(b, "x double, y double"), "k", "ax", "ay", "x", "y", 5.0)
    want = {}
    for k, x, y in a[:-1]:
        own = [p for p, q in b[:-1] if np.sqrt((p - x) ** 2 + (q - y) ** 2) <= 5.0]
        if own:
            want[k] = (len(own), pytest.approx(sum(own)))
    assert {r.k: (r.n, r.total) for r in out.collect()} == want


def test_toxicity_is_trained_in_a_task(spark, monkeypatch):
    """Not in the driver, whose memory the texts and the training would take."""
    toxicity = pytest.importorskip("tidewater.llm.toxicity_gru")
    docs = spark.createDataFrame([(k, f"word{k % 7} " * 12 + ("vile" if k % 2 else "kind")) for k in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, toxic int")
    assert "scale" in toxicity.fitted(docs, labels) and toxicity.fitted(docs.limit(0), labels) is None
    monkeypatch.setattr(toxicity, "fit", lambda *_: {"process": os.getpid()})
    assert toxicity.fitted(docs, labels).get("process") != os.getpid()


def test_spearman_of_odd_groups(spark, duck, tmp_path):
    """Ties, single rows and groups in which a value never varies, which once divided by zero, against the SQL."""
    rng = np.random.default_rng(9)
    rows = [(int(g), float(q), float(p)) for g, q, p in zip(rng.integers(0, 5, 400), rng.integers(0, 6, 400), rng.integers(0, 40, 400))]
    rows += [(7, 1.0, 2.0), (8, 1.0, 2.0), (8, 1.0, 3.0), (9, 1.0, 2.0), (9, 4.0, 2.0), (None, 1.0, 2.0), (None, 4.0, 3.0), (None, 9.0, -1.0)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(f"{d}/lineitem.parquet")
    got, want = same(registry.QUERIES["agg_spearman"](spark, d), duck, registry.ORACLES["agg_spearman"].replace("FROM lineitem", f"FROM '{d}/lineitem.parquet/*.parquet'"))
    assert got == want


def test_ranks_in_tasks_of_bounded_size(spark, monkeypatch):
    """However large the table, a task sorts about TASK_ROWS rows; equal scores are counted before they are sorted."""
    df = spark.range(4000).select((F.col("id") % 400).alias("g"), F.col("id").alias("x"), (-F.col("id")).alias("y"))
    monkeypatch.setattr(A, "TASK_ROWS", 100)
    assert A.dealt(df, ["g"]).rdd.getNumPartitions() == 40
    assert {r.spearman for r in A.spearman(df, ["g"], "x", "y").collect()} == {-1.0}
    scores = spark.range(5000).select((F.col("id") % 2).alias("g"), (F.col("id") % 50).alias("x"))
    plan = S.auc(scores, ["g"], "x", F.col("x") > 30)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window [sum(_n") < plan.index("partial_count(1)")  # plans are written from their end on
    assert [r.auc for r in S.auc(scores, ["g"], "x", F.col("x") > 30).collect()] == [1.0, 1.0]


def test_boosted_rows_in_tasks_of_bounded_size(spark, monkeypatch):
    """What a task of the fit keeps and reads for every level doesn't grow with the table, and no row is left out."""
    regression = pytest.importorskip("pyspark.ml.regression")
    fit, sizes = regression.GBTRegressor.fit, []
    monkeypatch.setattr(A, "TASK_ROWS", 500, raising=False)
    monkeypatch.setattr(regression.GBTRegressor, "fit", lambda self, rows: sizes.extend(rows.rdd.mapPartitions(lambda own: [sum(1 for _ in own)]).collect()) or fit(self, rows))
    assert registry.QUERIES["ml_gbt"](spark, DATA).count() == spark.read.parquet(f"{DATA}/lineitem.parquet").where("l_orderkey % 5 = 0").count()
    assert sum(sizes) == spark.read.parquet(f"{DATA}/lineitem.parquet").where("l_orderkey % 5 <> 0").count() and max(sizes) < 1000
