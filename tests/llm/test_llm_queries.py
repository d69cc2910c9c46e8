"""The registered queries of the corpus operators: against SQL where it exists, and the pipeline against its stages by hand."""

from __future__ import annotations

import pytest
from support import DATA, same

from tidewater.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got, want = same(queries.QUERIES[name](spark, DATA), duck, queries.ORACLE_SQL[name])
    assert got == want


def test_pipeline(spark):
    import corpus_pipeline
    from tidewater.llm import decontaminate, parity_join, quality_knn, toxicity_gru

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: {r.doc_id for r in df.collect()}
    good = docs.join(quality_knn.scored(docs, labels).where("predicted = 1"), "doc_id", "left_semi")
    mild = good.join(toxicity_gru.scored(good, labels).where("predicted = 0"), "doc_id", "left_semi")
    single = mild.join(parity_join.linked_documents(mild).where("doc_id = component_id"), "doc_id", "left_semi")
    clean = single.join(decontaminate.contaminated(single, bench), "doc_id", "left_anti")
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert ids(out) == ids(clean) and 0 < len(ids(clean)) < docs.count()


def test_pipeline_on_odd_tables(spark, tmp_path, prose):
    import corpus_pipeline

    long = prose(7, 20_000)
    rows = [(1, prose(1, 60)), (2, prose(1, 60)), (3, None), (4, ""), (5, " \n "), (6, prose(6, 60)), (6, prose(6, 60)), (6, prose(8, 60)), (None, "no key here"), (None, "no key here"), (7, long), (8, "zig " + prose(99, 30)), (9, "x" * 70_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, n_tokens int")
    bench = spark.createDataFrame([(1, prose(99, 30)), (2, None), (3, "")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (50, 0, 1)], "doc_id long, quality int, toxic int")
    for name, d, b, lab in (("odd", docs, bench, labels), ("bare", docs, bench.limit(0), labels.limit(0)), ("none", docs.limit(0), bench, labels)):
        base = tmp_path / name
        for table, df in (("documents", d), ("benchmark", b), ("labels", lab)):
            df.write.parquet(f"{base}/{table}.parquet")
        got = sorted((r.doc_id is None, r.doc_id or 0) for r in corpus_pipeline.run(spark, str(base)).collect())
        if name == "none":
            assert got == []
        elif name == "bare":
            assert got == [(False, k) for k in (1, 3, 4, 5, 6, 7, 8, 9)] + [(True, 0)] * 2
    kept = {}
    for name, stage in corpus_pipeline.STAGES[2:4]:
        out = stage(spark, docs, f"{tmp_path}/odd")
        assert out.columns == docs.columns
        kept[name] = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
    assert kept["n-gram Jaccard join"] == [(False, k) for k in (1, 3, 4, 5, 6, 7, 8, 9)] + [(True, 0)] * 2
    assert kept["benchmark decontamination"] == sorted([(False, k) for k in (1, 2, 3, 4, 5, 6, 6, 6, 7, 9)] + [(True, 0)] * 2)
