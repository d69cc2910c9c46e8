"""A corpus pipeline of five stages: what each one keeps is written as Parquet and read again by the next.

Each stage works on all documents that the one before kept. All but the last return the columns of
documents; the last gives each remaining document's token count and digests.

Edge cases, as the operators define them: null and empty texts score the share of good labels, are
never toxic, near to nothing and free of benchmark items, and have no tokens; of rows with one
doc_id, the Jaccard stage keeps one, and rows without doc_id stay as they are; of equal texts the one
of least doc_id stays; very long texts are judged whole; an empty table gives no rows; further
columns of documents pass through to the last stage, whatever their names. Without labels of both
classes the classifiers keep or drop by the one class there is, and without any they keep all.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import decontaminate, parity_join, piece_codec, quality_knn, toxicity_gru
from tidewater.llm.common import dropped, shared_dir, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_knn.good_only(docs, table(spark, sf_dir, "labels"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity_gru.clean_only(docs, table(spark, sf_dir, "labels"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return parity_join.one_of_each(docs).select(*docs.columns)


def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("n-gram Jaccard join", one_of_near_duplicates),
    ("benchmark decontamination", not_contaminated),
    ("SentencePiece encoding and decoding", tokens),
]

#: The classifiers and the edit matching can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/tidewater/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out.write.parquet(f"{base}/{k}")
            out = spark.read.parquet(f"{base}/{k}")
            if k:
                dropped(docs)  # the stage before has been read
        docs = out
    return docs
