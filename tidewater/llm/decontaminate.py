"""Benchmark decontamination by pigeonhole edit matching.

Texts are words: lower-cased runs of letters and digits (bytes beyond ASCII count as letters). A
document holds a benchmark item if some stretch of its words is within k edits (words put in, left
out or changed) of the item's m words, k = m * ERROR_PERCENT / 100. An item is split in k + 1
pieces, one of which such a stretch must contain unchanged. Windows of piece length are looked up
in sorted piece codes over the whole text, in numpy; around each hit Myers' bit-parallel algorithm
finds the least distance of the whole item.

Items are a query set held against all documents: they are broadcast in blocks of at most
BLOCK_ITEMS items and BLOCK_BYTES of text, so the broadcast stays bounded for any number of items.
Documents are scanned without shuffle.

Edge cases: items without words never match; null and empty texts hold nothing; of equal items each
one matches; repeated rows give repeated pairs; empty tables give no rows; only doc_id, item_id and
the texts are read.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, kept_rows, pieces, small_batches, text_column
from .hashing import U64, Words, mix, powers, slices
from .toxicity_gru import MARKS

ERROR_PERCENT = 20
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 32 << 20


def lowered(texts: list[str | None]) -> list[bytes]:
    return [(t or "").lower().encode() for t in texts]


def budget(words: int, percent: int = ERROR_PERCENT) -> int:
    return words * percent // 100


def window_codes(codes: np.ndarray, size: int) -> np.ndarray:
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    weights = powers(size)[0]
    with np.errstate(over="ignore"):
        return mix(sum((codes[k : n + k] * weights[k] for k in range(size)), np.full(n, U64(size))))


class Items:
    """Word codes of items, and their pieces by length: sorted codes, item and offset."""

    def __init__(self, ids: list[int], texts: list[str], percent: int = ERROR_PERCENT):
        self.ids, self.codes, self.masks, self.errors = ids, [], [], []
        parts: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for item, text in enumerate(lowered(texts)):
            codes = Words([text], blank=MARKS).codes
            m = len(codes)
            k = budget(m, percent)
            self.codes.append(codes)
            self.errors.append(k)
            masks: dict[int, int] = defaultdict(int)
            for at, c in enumerate(codes.tolist()):
                masks[c] |= 1 << at
            self.masks.append(dict(masks))
            edges = [m * p // (k + 1) for p in range(k + 2)]
            for a, b in zip(edges, edges[1:], strict=False):
                if b > a:
                    parts[b - a].append((int(window_codes(codes[a:b], b - a)[0]), item, a))
        self.pieces = {}
        for size, found in parts.items():
            found.sort()
            self.pieces[size] = (np.array([f[0] for f in found], U64), np.array([f[1] for f in found]), np.array([f[2] for f in found]))


def least_distance(masks: dict[int, int], m: int, text: list[int]) -> int:
    """The least number of edits between the item and any stretch of text, by Myers' bit-parallel columns."""
    every, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = every, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        d0 = ((((eq & up) + up) ^ up) | eq | down) & every
        hp, hn = (down | ~(d0 | up)) & every, up & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = hp << 1 & every, hn << 1 & every
        up, down = (hn | ~(d0 | hp)) & every, hp & d0
        if score < best:
            best = score
    return best


def matches(items: Items, texts: list[bytes]) -> list[tuple[int, int, int]]:
    """(text, item, distance) of every text and item within the item's budget."""
    words = Words(texts, blank=MARKS)
    count = words.counts()
    of = np.repeat(np.arange(len(texts)), count)
    spans: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for size, (codes, item, offset) in items.pieces.items():
        seen = window_codes(words.codes, size)
        low, high = np.searchsorted(codes, seen, "left"), np.searchsorted(codes, seen, "right")
        at = np.flatnonzero(high > low)
        at = at[of[at] == of[at + size - 1]]
        for p, a, b in zip(at.tolist(), low[at].tolist(), high[at].tolist(), strict=True):
            for hit in range(a, b):
                i = int(item[hit])
                start = p - int(offset[hit]) - items.errors[i]
                spans[int(of[p]), i].append((start, start + len(items.codes[i]) + 2 * items.errors[i]))
    out = []
    for (text, i), stretches in spans.items():
        first, last, m = int(words.first[text]), int(words.first[text + 1]), len(items.codes[i])
        best, end = m, -1
        stretches.sort()
        for a, b in stretches:
            a, b = max(a, first), min(b, last)
            if b <= end:
                continue
            if a < end:  # go on from what has been read, with an item's length of it
                a = max(a, end - m - items.errors[i])
            end = b
            best = min(best, least_distance(items.masks[i], m, words.codes[a:b].tolist()))
            if best == 0:
                break
        if best <= items.errors[i]:
            out.append((text, i, best))
    return out


def item_blocks(benchmark: DataFrame):
    """Items in blocks of bounded size, in order of item_id."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_column(benchmark).alias("text")).orderBy("item_id").toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        size += len(r.text)
        if len(ids) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def index(shared, percent: int) -> Items:
    """The pieces of a block of items, kept by the Python worker."""
    return held(block_name(shared, percent), lambda: Items(*shared.value[:2], percent))


def block_name(shared, percent: int) -> str:
    return f"items {shared.value[2]} {percent}"


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = ERROR_PERCENT) -> DataFrame:
    """doc_id, item_id, item_words and distance of every document and item that it holds."""
    spark, out = docs.sparkSession, None
    small_batches(docs)
    names = ["doc_id", "item_id", "item_words", "distance"]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    for ids, texts in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast((ids, texts, uuid.uuid4().hex))

        def run(batches, shared=shared):
            items = index(shared, percent)
            for b in pieces(batches, block_name(shared, percent)):
                keys, raw = b.column(0).to_pylist(), lowered(b.column(1).to_pylist())
                found = [(a + t, i, d) for a, z in slices(raw) for t, i, d in matches(items, raw[a:z])]
                columns = ([keys[t] for t, _, _ in found], [items.ids[i] for _, i, _ in found], [len(items.codes[i]) for _, i, _ in found], [d for _, _, d in found])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        block = source.mapInArrow(run, "doc_id long, item_id long, item_words long, distance long")
        out = block if out is None else out.unionByName(block)
    return spark.createDataFrame([], "doc_id long, item_id long, item_words long, distance long") if out is None else out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = ERROR_PERCENT) -> DataFrame:
    """docs without the rows whose text holds an item."""
    for ids, texts in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast((ids, texts, uuid.uuid4().hex))

        def clean(texts, shared=shared):
            items, raw = index(shared, percent), lowered(texts)
            out = np.ones(len(raw), bool)
            for a, z in slices(raw):
                for t, _, _ in matches(items, raw[a:z]):
                    out[a + t] = False
            return out

        docs = kept_rows(docs, clean, holds=lambda shared=shared: block_name(shared, percent))
    return docs
