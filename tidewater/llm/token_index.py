"""Token ids in segments of raw 32-bit payload, found by document key through a minimal perfect hash.

Documents are dealt by key range and sorted; each task tokenizes its run and packs it in segments of
about SEGMENT_IDS ids. A segment holds the raw little-endian payload and an index: a minimal perfect
hash of its document keys (hash and displace: buckets get a seed that sends their keys to free
places), and for each place a fingerprint of the key, the key, its first id and its number of ids. A
lookup reads one seed and one place; a key that is not there is told by its fingerprint, or else by
the key itself. All reading, of single documents and of whole tables, goes through these lookups.

Each Python worker keeps the ids of words it has met, in two generations of at most KEPT_WORDS words.

Segments are rows of a Parquet table, so writing commits whole files, survives lost executors and
works in any store Spark can write to. Keys find their segment by the key range in the row, which
the reader pushes down to file statistics. Where a segment starts among all ids comes from running
sums over segment sizes, not from the ids.

Edge cases: a null or empty text has the end id alone; a repeated or null key gets one entry for each
row (the key is doc_id and its occurrence in the segment, and nulls are told from numbers); an empty table writes no segments; very
long texts make a segment of their own.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from itertools import count
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held, pieces, small_batches, text_column
from .hashing import U64, mix

END_ID = 1
SEGMENT_IDS = 1 << 18
KEPT_WORDS = 400_000
#: Longer words are not kept, so that a table's bytes are bounded with its words.
KEPT_LENGTH = 48
KEYS_PER_BUCKET = 4
#: More texts at once share more of their words; a batch has 4 MB at most or one long text.
ROWS_AT_ONCE = 2048
#: Letters, then marks that the tokenizer never joins to letters: the two can be encoded apart. İ ends in a mark once lower-cased.
MARKS = ".,!?&$%*#|:;"
WORD_AND_MARKS = re.compile(rf"([^\W\d_]*[^\W\d_İ])([{MARKS}]+)")
MARKS_ALONE = re.compile(f"[{MARKS}]+")


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in turn, as characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


BYTE_LETTERS = byte_letters()


class WordTokenizer:
    """Ids of whole texts by the tokenizers library, which sees each distinct word once.

    Blanks separate words for this tokenizer and it keeps nothing of them, so a text's ids are those of
    its words in turn.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def plain(part: str) -> str | None:
        """The part as the tokenizer's merges see it, if normalizing changes nothing and it is one word: letters alone or marks alone."""
        if part.isascii():
            return part if part.isalpha() or MARKS_ALONE.fullmatch(part) else None
        if part.isalpha() and is_normalized("NFC", part) and part == part.lower():
            return part.encode().decode("latin-1").translate(BYTE_LETTERS)
        return None

    def merged(self, word: str) -> bytes:
        """The ids of what is one word to the tokenizer, as its merges see it: only these are left to do."""
        ids = array("I", [t.id for t in self.merges(word)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def learn(self, words: set[str]) -> list[str]:
        """Gives the young table the ids of these words; the long ones, which are not to be kept, come back."""
        young, old, cut, odd = self.young, self.old.get, {}, []
        for c in words:
            ids = old(c)
            if ids is not None:
                young[c] = ids
                continue
            if c.isascii():
                if c.isalpha():
                    low = c.lower()
                    ids = self.merged(low) if low == c else young.get(low) or old(low)
                    if ids is None:
                        ids = young[low] = self.merged(low)
                    young[c] = ids
                    continue
                m = WORD_AND_MARKS.fullmatch(c)
                parts = (m[1].lower(), m[2]) if m else (c if "<|" in c else c.lower(),)  # a special token's name is one only as it is written
            elif (mapped := self.plain(c)) is not None:
                young[c] = self.merged(mapped)
                continue
            else:
                parts = m.groups() if (m := WORD_AND_MARKS.fullmatch(c)) else (c,)
                parts = tuple([p if "<|" in p or "Σ" in p or "İ" in p or not is_normalized("NFC", p) else p.lower() for p in parts])
            for p in parts:
                if p not in young:
                    ids = old(p)
                    if ids is not None:
                        young[p] = ids
                    elif (mapped := self.plain(p)) is None:
                        young[p] = b""  # until the library has encoded it
                        odd.append(p)
                    else:
                        young[p] = self.merged(mapped)
            cut[c] = parts
        for p, e in zip(odd, self.tokenizer.encode_batch(odd, add_special_tokens=False), strict=True):
            young[p] = np.array(e.ids, "<u4").tobytes()
        young.update([(c, young[parts[0]] if len(parts) == 1 else young[parts[0]] + young[parts[1]]) for c, parts in cut.items()])
        return [w for c, parts in cut.items() for w in (c, *parts) if len(w) > KEPT_LENGTH] + [v for w in words if len(w) > KEPT_LENGTH for v in (w, w.lower())]

    def encode(self, texts: list[str] | pa.Array, end: bytes) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers, then end.

        Arrow cuts the texts, numbers their distinct words and lays the ids in line; Python sees each distinct word once. Letters
        alone, or letters and then marks, are looked up apart, and the letters in lower case where they are ASCII.
        """
        if not len(texts):
            return []
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        own = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = own.flatten().dictionary_encode()
        whole = words.dictionary
        letters = pc.ascii_rtrim(whole, MARKS)
        apart = pc.and_not(pc.utf8_is_alpha(letters), pc.ends_with(letters, "İ"))
        lower = pc.if_else(pc.string_is_ascii(letters), pc.ascii_lower(letters), letters)
        marks = pc.replace_substring_regex(whole, f"^.*[^{MARKS}]", "")
        parts = pa.concat_arrays([pc.if_else(apart, lower, whole), pc.if_else(apart, marks, pa.scalar("", pa.large_string()))]).dictionary_encode()
        distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(parts.dictionary)], parts.dictionary), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
        ids = list(map(self.young.get, distinct))
        passing = self.learn({w for w, i in zip(distinct, ids, strict=True) if i is None})
        ids = pa.array([self.young[w] if i is None else i for w, i in zip(distinct, ids, strict=True)], pa.large_binary())
        first, second = ids.take(parts.indices[: len(whole)]), ids.take(parts.indices[len(whole) :])
        laid = pc.binary_join_element_wise(first, second, pa.scalar(b"", pa.large_binary())).take(words.indices)
        starts = np.frombuffer(laid.buffers()[1], np.int64)[laid.offset :]
        edges = starts[np.concatenate([[0], np.cumsum(pc.list_value_length(own).to_numpy())])].tolist()
        payload = memoryview(laid.buffers()[2] or b"")
        for w in passing:
            self.young.pop(w, None)
        if len(self.young) >= KEPT_WORDS:
            self.young, self.old = {}, self.young
        return [b"".join((payload[a:b], end)) for a, b in zip(edges, edges[1:])]


def tokenizer(path: str) -> WordTokenizer:
    return held(f"words {path}", lambda: WordTokenizer(path))


def key_codes(keys: np.ndarray, occurrence: np.ndarray, null: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(keys.astype(np.int64).view(U64) + U64(0x632BE59BD9B4E019)) + occurrence.astype(U64) * U64(0x9E3779B97F4A7C15) + null.astype(U64))


def place_of(codes: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(codes ^ (seeds.astype(U64) * U64(0xD1342543DE82EF95))) % U64(n)).astype(np.int64)


def perfect_hash(codes: np.ndarray) -> np.ndarray:
    """Seeds, one for each bucket, that send n distinct codes to n places."""
    n = len(codes)
    buckets = max(1, -(-n // KEYS_PER_BUCKET))
    of = ((codes >> U64(32)) % U64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(buckets + 1))
    seeds, taken = np.zeros(buckets, np.uint32), np.zeros(n, bool)
    for b in np.argsort(np.diff(edges), kind="stable")[::-1]:
        mine = codes[order[edges[b] : edges[b + 1]]]
        if not len(mine):
            continue
        tries = np.arange(1, 257, dtype=np.uint32)
        while True:
            at = place_of(mine[None, :], tries[:, None], n)
            free = ~taken[at].any(axis=1)
            if len(mine) > 1:
                free &= (np.diff(np.sort(at, axis=1), axis=1) > 0).all(axis=1)
            if free.any():
                k = int(np.argmax(free))
                seeds[b] = tries[k]
                taken[at[k]] = True
                break
            tries = tries + np.uint32(256)
    return seeds


INDEX_ENTRY = np.dtype([("fingerprint", "<u4"), ("occurrence", "<u4"), ("key", "<i8"), ("null", "?"), ("first", "<u8"), ("count", "<u8")])


def pack(keys: list[int | None], ids: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Seeds, index entries and payload of a segment."""
    key, null = np.array([k or 0 for k in keys], np.int64), np.array([k is None for k in keys], bool)
    order = np.lexsort((key, null))
    fresh = np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(null[order]) != 0)]) if len(key) else np.zeros(0, bool)
    runs = np.flatnonzero(fresh)
    occurrence = np.empty(len(key), np.int64)
    occurrence[order] = np.arange(len(key)) - np.repeat(runs, np.diff(np.concatenate([runs, [len(key)]])))
    codes = key_codes(key, occurrence, null)
    seeds = perfect_hash(codes)
    at = place_of(codes, seeds[bucket_of(codes, len(seeds))], len(codes))
    counts = np.array([len(x) // 4 for x in ids], np.uint64)
    entries = np.zeros(len(codes), INDEX_ENTRY)
    entries["fingerprint"][at] = (codes & U64(0xFFFFFFFF)).astype(np.uint32)
    entries["occurrence"][at], entries["key"][at], entries["null"][at] = occurrence, key, null
    entries["first"][at], entries["count"][at] = np.cumsum(counts) - counts, counts
    return seeds.tobytes(), entries.tobytes(), b"".join(ids)


def bucket_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    return ((codes >> U64(32)) % U64(buckets)).astype(np.int64)


def places(seeds: np.ndarray, entries: np.ndarray, keys: np.ndarray, occurrence: np.ndarray, null: np.ndarray) -> np.ndarray:
    """The index entry of each key, -1 for those that the segment lacks: one seed and one place are read for each."""
    if not len(entries):
        return np.full(len(keys), -1)
    codes = key_codes(keys, occurrence, null)
    at = place_of(codes, seeds[bucket_of(codes, len(seeds))], len(entries))
    found = entries[at]
    here = (found["fingerprint"] == (codes & U64(0xFFFFFFFF))) & (found["key"] == keys) & (found["occurrence"] == occurrence) & (found["null"] == null)
    return np.where(here, at, -1)


def lookup(seeds: bytes, entries: bytes, payload: bytes, key: int | None, occurrence: int = 0) -> bytes | None:
    """The ids of a key's row in constant time, or None if it is not in the segment."""
    entry = np.frombuffer(entries, INDEX_ENTRY)
    at = places(np.frombuffer(seeds, np.uint32), entry, np.array([key or 0]), np.array([occurrence]), np.array([key is None]))[0]
    return None if at < 0 else payload[4 * int(entry[at]["first"]) : 4 * (int(entry[at]["first"]) + int(entry[at]["count"]))]


SEGMENTS = "part int, seq int, first_key long, last_key long, nulls int, n_docs int, part_start long, n_ids long, seeds binary, entries binary, payload binary"
SEGMENT_SCHEMA = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("nulls", pa.int32()), ("n_docs", pa.int32()), ("part_start", pa.int64()), ("n_ids", pa.int64()), ("seeds", pa.binary()), ("entries", pa.binary()), ("payload", pa.binary())]
)


def write_segments(docs: DataFrame, tokenizer_file: str, path: str, parts: int | None = None) -> None:
    """Tokenizes all texts and writes them, in ascending doc_id order, as segments at path."""
    spark = docs.sparkSession
    small_batches(docs)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = np.array([END_ID], "<u4").tobytes()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, keys, ids, size, before = TaskContext.get().partitionId(), 0, [], [], 0, 0

        def row():
            seeds, entries, payload = pack(keys, ids)
            known = [k for k in keys if k is not None]
            values = (part, seq, min(known, default=None), max(known, default=None), len(keys) - len(known), len(keys), before, len(payload) // 4, seeds, entries, payload)
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, SEGMENT_SCHEMA, strict=True)], schema=SEGMENT_SCHEMA)

        for b in pieces(batches, f"words {tokenizer_file}", ROWS_AT_ONCE):
            for key, own in zip(b.column(0).to_pylist(), tokenizer(tokenizer_file).encode(b.column(1), end), strict=True):
                keys.append(key)
                ids.append(own)
                size += len(own) // 4
                if size >= SEGMENT_IDS:
                    yield row()
                    seq, keys, ids, size, before = seq + 1, [], [], 0, before + size
        if keys:
            yield row()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    # ranges of key and text: rows of one common key still spread over tasks
    dealt = texts.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    dealt.mapInArrow(segments, SEGMENTS).write.option("compression", "zstd").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with start, the number of ids in all segments before."""
    rows = spark.read.schema(SEGMENTS).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_ids").alias("ids"))  # a row for each writing task
    before = totals.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    return rows.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("part_start"))


def documents_of(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the payloads."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, seeds, entries, payload in zip(*(b.column(k) for k in range(4)), strict=True):
                entry, data = np.frombuffer(entries.as_py(), INDEX_ENTRY), memoryview(payload.as_py())
                wanted = np.sort(entry, order="first")  # the segment's keys in order
                at = places(np.frombuffer(seeds.as_py(), np.uint32), entry, wanted["key"], wanted["occurrence"], wanted["null"])
                if (at < 0).any():
                    raise ValueError("the index of a segment lacks some of its keys")
                first, n_ids = entry["first"][at].astype(np.int64), entry["count"][at].astype(np.int64)
                crc = [zlib.crc32(data[4 * f : 4 * (f + n)]) for f, n in zip(first.tolist(), n_ids.tolist(), strict=True)]
                keys = pa.array(wanted["key"], mask=wanted["null"])
                yield pa.RecordBatch.from_arrays([keys, pa.array(first + start.as_py()), pa.array(n_ids), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.select("start", "seeds", "entries", "payload").mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long")


def ids_of(spark: SparkSession, path: str, key: int | None) -> list[np.ndarray]:
    """The ids of every row with this key, in the order of the file; none if there is no such row."""
    hit = F.col("nulls") > 0 if key is None else (F.col("first_key") <= key) & (F.col("last_key") >= key)
    rows, out = spark.read.schema(SEGMENTS).parquet(path).where(hit), []
    for r in rows.orderBy("part", "seq").select("seeds", "entries", "payload").toLocalIterator():
        segment = (bytes(r.seeds), bytes(r.entries), bytes(r.payload))
        for occurrence in count(0):
            found = lookup(*segment, key, occurrence)
            if found is None:
                break
            out.append(np.frombuffer(found, "<u4"))
    return out
