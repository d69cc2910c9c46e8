"""Scans and sinks round trip; the entry points work without the corpus operators."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

from support import DATA
from pyspark.sql import functions as F

from tidewater.operators import joins
from tidewater.sources import sinks, tables


def test_typed_csv_keeps_codes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n0012,1.5\n0400,\n")
    rows = tables.typed_csv(spark, str(tmp_path / "a.csv"), "k string, v double").collect()
    assert [tuple(r) for r in rows] == [("0012", 1.5), ("0400", None)]
    assert tables.text_csv(spark, str(tmp_path / "a.csv"), ["k", "v"]).dtypes == [("k", "string"), ("v", "string")]


def test_prefiltered_tsv(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("1\tABC\tx\n2\tABD\ty\n3\tzABC\tz\n")
    out = tables.prefiltered_tsv(spark, str(tmp_path / "a.tsv"), ["id", "code", "v"], ["ABC"], F.col("code") == "ABC")
    assert [tuple(r) for r in out.collect()] == [("1", "ABC", "x")]


def test_wide_text(spark, tmp_path):
    (tmp_path / "w.txt").write_text("title line\n1990 " + " ".join(["1.0"] * 11) + " -99.9\n")
    out = tables.wide_text_to_long(spark, str(tmp_path / "w.txt"), -99.9).collect()
    assert len(out) == 12 and out[-1].month == 12 and out[-1].value is None and out[0].value == 1.0


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.0)], "k int, x double")
    assert [r.x for r in tables.nan_to_null(df).orderBy("k").collect()] == [None, None, 1.0]
    assert '"x":null' in sinks.json_rows(df).first().json


def test_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, day string")
    sinks.write_parquet(df, path, by=["day"])
    sinks.write_parquet(spark.createDataFrame([(9, "b")], "k int, day string"), path, mode="overwrite", by=["day"])
    assert sorted((r.k, r.day) for r in spark.read.parquet(path).collect()) == [(1, "a"), (9, "b")]
    sinks.write_parquet(df.where("k = 1"), path, mode="append", by=["day"])
    assert spark.read.parquet(path).count() == 3


def test_replacing_keys_twice_changes_nothing(spark):
    old, new = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    once = sinks.replace_keys(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, sinks.replace_keys(once, new, ["k"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]


def test_pushdown_and_pruning(spark):
    df = spark.read.parquet(f"{DATA}/lineitem.parquet").where("l_quantity > 45").select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan and "l_comment" not in plan and "l_extendedprice" not in plan


def test_point_in_polygon(spark):
    df = spark.createDataFrame([(1, 5.0, 5.0), (2, 11.0, 5.0), (3, -1.0, 3.0), (4, 9.9, 0.1)], "id int, x double, y double")
    square = spark.createDataFrame([([{"x": x, "y": y} for x, y in ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0))],)], "ring array<struct<x: double, y: double>>")
    assert sorted(r.id for r in joins.in_polygons(df, square, "x", "y", "ring", 3.0).collect()) == [1, 4]


def test_zip_archives(spark, tmp_path):
    """Members by name from archives as files: header lines go, quoted and empty values stay."""
    import zipfile

    for k in range(2):
        with zipfile.ZipFile(tmp_path / f"a{k}.zip", "w") as z:
            z.writestr("data_1.csv", "x,y\r\n1,one\r\n2,\r\n")
            z.writestr("data_2.csv", 'x,y\n3,"a, b"\n')
            z.writestr("readme.txt", "x,y\n9,no\n")
            z.writestr("data_3.csv", "")
    archives = spark.read.format("binaryFile").load(f"{tmp_path}/*.zip")
    got = sorted((r.x, r.y or "") for r in tables.zip_csv(archives, r"data_\d\.csv", "x int, y string").collect())
    assert got == sorted([(1, "one"), (2, ""), (3, "a, b")] * 2)


def test_entry_points_without_corpus_operators(tmp_path):
    """A copy without the corpus folders and the pipeline still imports and lists its queries."""
    import shutil

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "tidewater", tmp_path / "tidewater", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
