"""Bounded samples of labelled texts for fitting, and the held-out rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_column

SAMPLE_BYTES = 32 << 20


def remainder(key, modulus: int):
    """crc32 of the key as text, by the modulus."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus))


def held_out(key, modulus: int, rest: int):
    """True for rows that no fit may see."""
    return F.coalesce(remainder(key, modulus) == rest, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, column: str, modulus: int, rest: int, per_class: int) -> DataFrame:
    """doc_id, text and label of at most per_class documents and SAMPLE_BYTES of text of each class, those of least hash; none is held out.

    Only ids that docs has are drawn. Null labels are no labels; of a repeated doc_id the least label and the least text count.
    """
    usable = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, rest))
    usable = usable.groupBy("doc_id").agg(F.min(F.col(column).cast("int")).alias("label")).join(docs.select("doc_id"), "doc_id", "left_semi")
    drawn = None
    for value in (0, 1):
        some = usable.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        drawn = some if drawn is None else drawn.unionByName(some)
    # at most two times per_class rows, so the broadcast is bounded
    whole = docs.select("doc_id", text_column(docs).alias("text")).join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    before = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return whole.withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))).where(F.col("before") < SAMPLE_BYTES).select("doc_id", "text", "label")
