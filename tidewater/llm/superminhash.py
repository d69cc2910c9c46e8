"""Near duplicates by SuperMinHash signatures: banding, verification on full sets, and union-find grouping.

A document is the set of its distinct word shingles. Each element has a random number and a random
permutation of the signature's slots; at its rank j it offers j plus a fresh random number to the
slot that stands there, and a slot keeps the least offer. Two sets agree in a slot with the
probability of their Jaccard similarity, with less variance than independent hashes, as an element
can't win slots by chance twice at one rank. Ranks are taken level by level for all documents at
once: after level j a document whose slots all hold less than j + 1 is done, since later levels only
offer more. A large set is done after the first levels, a small one has few elements.

Banding: BANDS bands of ROWS slots. Linked documents agree in all slots of some band but for a chance
of (1 - s ** ROWS) ** BANDS, which is 5e-9 at s = 0.8 and far less above. Documents that agree in a band
form a bucket; sets that are equal are one node. Buckets are resolved as in parity_join: each set is
checked against the hub that it shares most bands with, and only sets that are still in different
classes and that their sketches don't rule out are checked further, on full sets. So groups of
copies never become all pairs, and no pair that shares a bucket is lost.

Grouping: union-find in each task, then over all tasks (see grouping).

Edge cases: null or empty texts, and texts without words, have no shingles and no links; texts of
fewer words than a shingle are one shingle and link only with their like; very long texts are taken
whole; repeated rows share their class, and each row of a class's least doc_id is kept; a row without
doc_id takes the class of its like, else null, and is kept where it has none; an empty table gives no
rows; only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, written
from .hashing import U64, Words, mix, shingles, slices
from .parity_join import PERCENT, classes, deals_of, fold_bytes, node_table, set_id, sketch, texts, texts_bytes

SHINGLE = 2
BANDS, ROWS = 48, 5
SLOTS = BANDS * ROWS
_LEVEL, _FRACTION = U64(56), U64((1 << 56) - 1)


def draws(codes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Offers of the elements at a level (the level in the top byte, a random fraction below), and random ranks from the level on."""
    with np.errstate(over="ignore"):
        x = mix(codes + U64((level + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        y = mix(x ^ U64(0x2545F4914F6CDD1D))
    return U64(level) << _LEVEL | x & _FRACTION, level + ((y >> U64(32)) * U64(SLOTS - level) >> U64(32)).astype(np.int64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SLOTS least offers for each set; all ones for empty sets."""
    out = np.full((len(sets), SLOTS), ~U64(0))
    codes = np.concatenate([*sets, np.zeros(0, U64)])
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat, order, first = out.reshape(-1), None, None
    for level in range(SLOTS):
        offer, rank = draws(codes, level)
        if level == 0:
            slot = first = rank  # the permutation starts in order
        else:
            if order is None:  # few elements get here, those of small sets
                order = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(codes), 1))
                every = np.arange(len(codes))
                order[every, 0], order[every, first] = order[every, first], 0
            every = np.arange(len(codes))
            slot = order[every, rank].astype(np.int64)
            order[every, rank] = order[every, level]
        np.minimum.at(flat, of * SLOTS + slot, offer)
        still = (out >> _LEVEL).max(axis=1)[of] > level  # a slot is empty or holds more than any later level could better
        if not still.any():
            break
        codes, of = codes[still], of[still]
        first = first[still] if order is None else None
        order = None if order is None else order[still]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A code for each band of each signature."""
    rows = signature.reshape(len(signature), BANDS, ROWS)
    key = np.arange(BANDS, dtype=U64) * U64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = mix(key ^ mix(rows[:, :, k] + U64(k)))
    return key


def set_table(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_id (null without shingles), sketches and band codes of every document."""
    kinds = {"doc_id": pa.int64(), "n_shingles": pa.int64(), "set_id": pa.int64(), "sketch": pa.binary(), "narrow": pa.binary(), "bands": pa.list_(pa.int64())}

    def run(batches):
        for b in pieces(batches):
            raw = texts_bytes(b.column(1))
            for start, end in slices(raw):
                sets = shingles(Words(raw[start:end]), size)
                keys = band_keys(signatures(sets)).view(np.int64)
                some = [len(s) > 0 for s in sets]
                bits = [sketch(s) if has else None for s, has in zip(sets, some, strict=True)]
                columns = (
                    b.column(0).slice(start, end - start),
                    [len(s) for s in sets],
                    [set_id(s) if has else None for s, has in zip(sets, some, strict=True)],
                    bits,
                    [fold_bytes(x) if x else None for x in bits],
                    [k if has else None for k, has in zip(keys, some, strict=True)],
                )
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) if isinstance(c, list) else c for c, kind in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, set_id long, sketch binary, narrow binary, bands array<long>")


def buckets(nodes: DataFrame) -> DataFrame:
    """bucket, set_id, members and times of the sets that agree in a band. Keys of one set alone go before anything is joined."""
    banded = nodes.select(F.explode("bands").alias("bucket"), "set_id")
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return banded.join(shared, "bucket").select("bucket", "set_id", "members", F.lit(1).cast("long").alias("times"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) and kept (it is the document's own) of every row."""
    sets = written(set_table(docs, size), "sets")
    deals, nodes = deals_of(sets), node_table(sets, "bands")
    out = classes(docs, sets, nodes, written(buckets(nodes), "buckets"), deals, size, percent)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
