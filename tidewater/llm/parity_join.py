"""Jaccard similarity join of texts by parity sketches.

A document is the set of its distinct word shingles. XOR-ing shingle codes into a bit sketch keeps,
for every bit, the parity of the shingles that fall on it; the Hamming distance of two sketches is
then at most the size of the sets' symmetric difference, and two sets of at least the wanted
similarity differ in at most d = (1 - s) / (1 + s) * (|A| + |B|) shingles.

Pigeonhole: in each size band the sketch is cut in more than d pieces, so linked documents agree in
some piece. The band's sketch is wide (2^64 bits a piece), and a piece is written as the XOR of one
code for each of its shingles, so unlike sets only agree in a piece where both are empty. There are
enough spare pieces that linked documents also agree in one that is not empty; a document with more
empty pieces than spares sends its empty ones too, as both of such a pair do.

Rounds. Documents that agree in a piece form a bucket. (1) Each document is checked against one
pivot: of each of its buckets the hub, the member with most mates over all buckets, and of these the
one it shares most pieces with. Around a much copied text that is the original, so most of a group
is one component after this round. (2) In buckets that still hold several components, sketches are
compared in blocks, and each document is checked against the nearest of every other component in its
bucket. (3) Where others were near, too, and the components of the nearest are still apart, they are checked as well. Only
pairs that pass the bound on their sketches' distance are ever checked. A check compares the shingle sets themselves. Links inside one component add nothing, so groups of copies never
become all pairs; exact copies (equal sets) are one node from the start.

Pieces travel packed (6 bytes of code, 2 of place) and dealt by code, in as many deals as keep each
to about DEAL_SHINGLES; a task holds only its share. Rounds' tables are deleted once they are read.

Edge cases: null or empty texts, and texts without words, have no shingles and no links; texts of
fewer words than a shingle are one shingle and link only with their like; repeated rows share their
class; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, dropped, pieces, small_batches, text_column, written
from .grouping import united
from .hashing import U64, mix, shingle_sets

SHINGLE = 5
PERCENT = 80
BAND = 1.25
#: Links of one hub that are checked together, and members of one bucket that are compared together.
BLOCK, BUCKET_BLOCK = 512, 2048
#: Bits of a sketch for each shingle, at least: fewer bits let more pairs just over the bound through to the check.
SKETCH_BITS = 6
#: In buckets, where unlike sets far over the bound meet, sketches come folded this many times.
FOLDS = 1
#: Shingles whose pieces a task puts in order at a time, on average.
DEAL_SHINGLES = 4_000_000
FLUSH_KEYS = 1 << 20
CHUNK = 64


def most_apart(sizes: int, percent: int = PERCENT) -> int:
    """The largest symmetric difference of linked sets whose sizes sum to sizes."""
    return sizes * (100 - percent) // (100 + percent)


def band_of(n: int) -> int:
    """Bands hold sizes in [BAND ** k, BAND ** (k + 1))."""
    k = int(math.log(n) / math.log(BAND))
    while BAND ** (k + 1) <= n:
        k += 1
    while BAND**k > n:
        k -= 1
    return k


@lru_cache(maxsize=4096)
def cut(band: int, percent: int) -> tuple[int, int]:
    """Greatest difference of pairs whose larger set is in the band, and the number of pieces."""
    top = math.ceil(BAND ** (band + 1)) - 1
    low = max(1.0, BAND**band * percent / 100)
    d = most_apart(2 * top, percent)
    n = d + 1
    for _ in range(8):
        n = d + 2 + math.ceil(1.5 * n * math.exp(-low / n))
    return d, n


def pieces_of(codes: np.ndarray, band: int, percent: int) -> np.ndarray:
    """Keys of a set's pieces among pairs of the band."""
    d, p = cut(band, percent)
    if d == 0 or not len(codes):
        return np.zeros(0, U64)  # only equal sets link
    piece = ((codes >> U64(32)) * U64(p)) >> U64(32)  # ascends with the code
    starts = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
    value = np.bitwise_xor.reduceat(mix(codes ^ U64(0xA0761D6478BD642F)), starts)
    at = piece[starts]
    if p - len(at) > p - d - 1:
        empty = np.setdiff1d(np.arange(p, dtype=U64), at)
        at, value = np.concatenate([at, empty]), np.concatenate([value, np.zeros(len(empty), U64)])
    with np.errstate(over="ignore"):
        return mix(value ^ mix(at + U64(band) * U64(0x9FB21C651E98DF25)))


def sketch_bits(n: int) -> int:
    return max(64, 1 << (SKETCH_BITS * n - 1).bit_length())


def sketch(codes: np.ndarray) -> bytes:
    """Parities of the codes' lowest bits; its size, a power of two, follows the set's size."""
    m = sketch_bits(len(codes))
    return np.packbits((np.bincount((codes & U64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of sketches of the same set codes at a smaller power of two: halves XORed."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def fold_bytes(bits: bytes) -> bytes:
    for _ in range(FOLDS):
        if len(bits) > 8:
            half = np.frombuffer(bits, np.uint8).reshape(2, -1)
            bits = (half[0] ^ half[1]).tobytes()
    return bits


def close(one: list[bytes], other: list[bytes], sizes: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Hamming distances of the pairs (one[i], other[k]) that sketches and sizes don't rule out, -1 for the others."""
    out = np.full((len(one), len(other)), -1, np.int64)
    lengths, lengths2 = np.array([len(x) for x in one]), np.array([len(x) for x in other])
    for a in np.unique(lengths):
        for b in np.unique(lengths2):
            if max(a, b) > 4 * min(a, b):
                continue
            i, k = np.flatnonzero(lengths == a), np.flatnonzero(lengths2 == b)
            words = int(min(a, b)) // 8
            left = folded(np.frombuffer(b"".join(one[x] for x in i), U64).reshape(len(i), -1), words)
            right = folded(np.frombuffer(b"".join(other[x] for x in k), U64).reshape(len(k), -1), words)
            for row, x in enumerate(i):
                apart = np.bitwise_count(left[row] ^ right).sum(axis=1, dtype=np.int64)
                out[x, k] = np.where(apart * (100 + percent) <= (100 - percent) * (sizes[x] + others[k]), apart, -1)
    small, large = np.minimum(sizes[:, None], others), np.maximum(sizes[:, None], others)
    return np.where(100 * small >= percent * large, out, -1)


def bound_holds(one: list[bytes], other: list[bytes], sizes: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Whether sketches and sizes leave open that the sets one[i] and other[i] are similar."""
    out = 100 * np.minimum(sizes, others) >= percent * np.maximum(sizes, others)
    lengths = np.array([[len(x), len(y)] for x, y in zip(one, other, strict=True)]).reshape(-1, 2)
    for a, b in np.unique(lengths[out], axis=0):
        at = np.flatnonzero(out & (lengths == (a, b)).all(axis=1))
        words = int(min(a, b)) // 8
        left, right = (folded(np.frombuffer(b"".join(side[x] for x in at), U64).reshape(len(at), -1), words) for side in (one, other))
        apart = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
        out[at] = apart * (100 + percent) <= (100 - percent) * (sizes[at] + others[at])
    return out


HUBS = "hubs"


def in_blocks(pairs: DataFrame) -> DataFrame:
    """by, other and block of pairs (a, b, by): links of one hub are dealt in blocks of about BLOCK. Only hubs of more are looked up, and they are few."""
    many = pairs.groupBy("by").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks")).where("blocks > 1")
    other = F.when(F.col("by") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    joined = pairs.join(broadcast_if_small(written(many, HUBS), F.lit(32)), "by", "left")
    return joined.select("by", other.alias("other"), F.pmod(F.xxhash64(other), F.coalesce("blocks", F.lit(1))).alias("block"))


def possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, by) whose sketches don't rule them out."""
    of, blocked = nodes.select("set_id", "n_shingles", "sketch"), in_blocks(pairs)
    hubs = blocked.select("by", "block").distinct().join(of.toDF("by", "n", "one"), "by")
    both = blocked.join(hubs, ["by", "block"]).join(of.toDF("other", "m", "two"), "other").select("by", "other", "n", "m", "one", "two")

    def run(batches):
        for b in pieces(batches):
            n, m = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            ok = bound_holds(b.column(4).to_pylist(), b.column(5).to_pylist(), n, m, percent)
            yield b.select(["by", "other"]).filter(pa.array(ok))

    left = both.mapInArrow(run, "by long, other long")
    return left.select(F.least("by", "other").alias("a"), F.greatest("by", "other").alias("b"), "by")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The exact test on sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def texts_bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def set_id(codes: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(mix(codes).sum(dtype=U64, keepdims=True) + U64(len(codes))).view(np.int64)[0])


def set_table(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_id (null without shingles), sketch and, folded, narrow sketch of every document."""
    names = ["doc_id", "n_shingles", "set_id", "sketch", "narrow"]

    def run(batches):
        for b in pieces(batches):
            n, ids, bits, narrow = [], [], [], []
            for codes in shingle_sets(texts_bytes(b.column(1)), size):
                n.append(len(codes))
                ids.append(set_id(codes) if len(codes) else None)
                bits.append(sketch(codes) if len(codes) else None)
                narrow.append(fold_bytes(bits[-1]) if len(codes) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(bits, pa.binary()), pa.array(narrow, pa.binary())], names=names)

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, set_id long, sketch binary, narrow binary")


def texts(docs: DataFrame) -> DataFrame:
    small_batches(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))


PACK = "deal int, high binary, low binary, place binary, sets binary"


def packed_pieces(docs: DataFrame, deals: int, size: int, percent: int) -> DataFrame:
    """All pieces of all documents, packed by the task that will get them."""

    def pack(keys: list[np.ndarray], ids: list[int]) -> Iterator[pa.RecordBatch]:
        place = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        every, owner = np.concatenate(keys), np.array(ids, np.int64)
        deal = ((every >> U64(48)) % U64(deals)).astype(np.int64)
        order = np.argsort(deal, kind="stable")
        edges = np.searchsorted(deal[order], np.arange(deals + 1))
        for r in range(deals):
            own = order[edges[r] : edges[r + 1]]
            if len(own):
                used, at = np.unique(place[own], return_inverse=True)
                key = every[own]
                columns = (r, (key >> U64(32)).astype(np.uint16).tobytes(), key.astype(np.uint32).tobytes(), at.astype(np.uint16).tobytes(), owner[used].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([columns[0]], pa.int32()), *(pa.array([c], pa.binary()) for c in columns[1:])], names=["deal", "high", "low", "place", "sets"])

    def run(batches):
        keys, ids, held = [], [], 0
        for b in pieces(batches):
            for codes in shingle_sets(texts_bytes(b.column(0)), size):
                if not len(codes):
                    continue
                band = band_of(len(codes))
                own = np.concatenate([pieces_of(codes, band, percent), pieces_of(codes, band + 1, percent)])
                ids.append(set_id(codes))
                keys.append(own)
                held += len(own)
                if held >= FLUSH_KEYS or len(keys) >= 65_000:
                    yield from pack(keys, ids)
                    keys, ids, held = [], [], 0
        if held:
            yield from pack(keys, ids)

    return texts(docs).select("text").mapInArrow(run, PACK)


def buckets(packed: DataFrame, deals: int) -> DataFrame:
    """bucket, set_id, members and times of sets that agree in a piece. Equal buckets come once, with the times that they are met.

    Sets that are alike agree in very many pieces, in as many equal buckets; these are merged by the task first, then over all.
    Until then a bucket travels as chunks of at most CHUNK of its sets in order.
    """

    def run(batches):
        keys, ids = [], []
        for b in batches:
            for high, low, place, sets in zip(*(b.column(k) for k in range(1, 5)), strict=True):
                keys.append(np.frombuffer(high.as_py(), np.uint16).astype(U64) << U64(32) | np.frombuffer(low.as_py(), np.uint32))
                ids.append(np.frombuffer(sets.as_py(), np.int64)[np.frombuffer(place.as_py(), np.uint16)])
        if not keys:
            return
        key, own = np.concatenate(keys), np.concatenate(ids)
        del keys, ids
        order = np.argsort(key)
        key, own = key[order], own[order]
        del order
        same = np.concatenate([[False], key[1:] == key[:-1]])
        keep = same | np.concatenate([same[1:], [False]])  # keys that come once go
        key, own = key[keep], own[keep]
        order = np.lexsort((own, key))
        key, own = key[order], own[order]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])]) if len(key) else np.zeros(0, bool)
        key, own = key[fresh], own[fresh]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate([starts, [len(key)]]))
        if not len(starts):
            return
        with np.errstate(over="ignore"):
            name = mix(np.add.reduceat(mix(own.view(U64)), starts) + count.astype(U64))
        name, first, times = np.unique(name, return_index=True, return_counts=True)
        starts, count = starts[first], count[first]
        wanted = count > 1
        starts, count, name, times = starts[wanted], count[wanted], name[wanted], times[wanted]
        if not len(count):
            return
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        chunks = -(-count // CHUNK)
        of = np.repeat(np.arange(len(count)), chunks)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        ends = np.cumsum(np.minimum(CHUNK, count[of] - CHUNK * nth))
        sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(own[at]))
        columns = [pa.array(c.astype(np.int64)) for c in (name.view(np.int64)[of], nth, count[of], times[of])]
        whole = pa.RecordBatch.from_arrays([*columns, sets], names=["bucket", "chunk", "members", "times", "sets"])
        for k in range(0, whole.num_rows, 20_000):
            yield whole.slice(k, 20_000)

    own = packed.repartition(deals, "deal").mapInArrow(run, "bucket long, chunk long, members long, times long, sets array<long>")
    merged = own.groupBy("bucket", "chunk").agg(F.first("sets").alias("sets"), F.first("members").alias("members"), F.sum("times").alias("times"))
    return merged.select("bucket", F.explode("sets").alias("set_id"), "members", "times")


def pivots(found: DataFrame) -> DataFrame:
    """For every set that hub of its buckets that it shares most pieces with."""
    degree = found.groupBy("set_id").agg(F.sum(F.col("times") * (F.col("members") - 1)).alias("degree"))
    ranked = found.select("bucket", "set_id", "times").join(degree, "set_id")
    hubs = ranked.groupBy("bucket").agg(F.max_by("set_id", F.struct("degree", "set_id")).alias("pivot"))
    stars = ranked.join(hubs, "bucket").where(F.col("set_id") != F.col("pivot"))
    counted = stars.groupBy("set_id", "pivot").agg(F.sum("times").alias("times"))
    return counted.groupBy("set_id").agg(F.max_by("pivot", F.struct("times", "pivot")).alias("pivot"))


def checked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, deals: int, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids whose sets are similar, written. Pairs are grouped by one of them, `by`, in blocks; a set goes once to each group."""
    blocked = in_blocks(pairs).select(F.col("by").alias("a"), F.col("other").alias("b"), "block")
    group = F.xxhash64("a", "block")
    sent = blocked.select(F.col("b").alias("set_id"), group.alias("group"), F.lit(1).alias("role"), F.col("a").alias("pivot"))
    sent = sent.unionByName(blocked.select(F.col("a").alias("set_id"), group.alias("group"), F.lit(0).alias("role"), F.col("a").alias("pivot")).distinct())
    wanted = sent.join(nodes.select("set_id", F.col("rep").alias("doc_id")), "set_id").groupBy("doc_id", "set_id").agg(F.collect_list(F.struct("group", "role", "pivot")).alias("to"))
    made = wanted
    wanted = written(made, "checks")
    dropped(made, HUBS)
    joined = texts(docs).join(broadcast_if_small(wanted, F.lit(48) + 32 * F.size("to")), "doc_id").select("text", "set_id", "to")

    def sets(batches):
        for b in pieces(batches):
            rows = []
            for codes, own, to in zip(shingle_sets(texts_bytes(b.column(0)), size), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if set_id(codes) != own:
                    continue  # another text of a repeated doc_id
                raw = codes.tobytes()
                rows += [(t["group"], t["role"], t["pivot"], own, raw) for t in to]
            for k in range(0, len(rows), 256):
                some = rows[k : k + 256]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], kind) for i, kind in enumerate(kinds)], names=["group", "role", "pivot", "set_id", "codes"])

    def compare(batches):
        pivot, codes = None, None
        for b in batches:
            a, out = [], []
            for role, group, own, raw in zip(b.column("role").to_pylist(), zip(b.column("group").to_pylist(), b.column("pivot").to_pylist(), strict=True), b.column("set_id").to_pylist(), b.column("codes"), strict=True):
                now = np.frombuffer(raw.as_py(), U64)
                if role == 0:
                    pivot, codes = group, now
                elif pivot == group and similar(codes, now, percent):
                    a.append(min(group[1], own))
                    out.append(max(group[1], own))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(out, pa.int64())], names=["a", "b"])

    dealt = joined.mapInArrow(sets, "group long, role int, pivot long, set_id long, codes binary")
    dealt = dealt.repartition(deals, "group").sortWithinPartitions("group", "pivot", "role")
    links = written(dealt.mapInArrow(compare, "a long, b long"), "links")
    dropped(wanted)
    return links


def split_buckets(found: DataFrame, nodes: DataFrame, labels: DataFrame, done: DataFrame, deals: int, percent: int, nearest: bool) -> DataFrame:
    """Pairs (a, b, bucket) of different components in one bucket that their sketches don't rule out, bucket by bucket in blocks.

    done: pairs that need no look; buckets of such a pair alone are left out at once.
    nearest: of two components only the smaller one's sets ask, each for the other's set nearest to it, by folded sketches; bucket is
    null where that is the only one near. Else all pairs, by whole sketches.
    """
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("weight"))
    sized = labels.join(broadcast_if_small(sizes, F.lit(24)), "label").select("node", "label", "weight")
    labelled = found.join(sized, found["set_id"] == sized["node"], "left").select("bucket", "set_id", "members", F.coalesce("label", "set_id").alias("label"), F.coalesce("weight", F.lit(1)).alias("weight"))
    ends = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("members").alias("n"), F.min("set_id").alias("a"), F.max("set_id").alias("b"))
    seen = done.select("a", "b", F.lit(2).cast("long").alias("n"))
    mixed = ends.where(F.col("low") != F.col("high")).join(seen, ["a", "b", "n"], "left_anti").select("bucket")
    open_ = labelled.join(mixed, "bucket").join(nodes.select("set_id", "n_shingles", F.col("narrow" if nearest else "sketch").alias("sketch")), "set_id")
    parts = F.ceil(F.col("members") / BUCKET_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("set_id"), parts).cast("int")
    sides = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("k")))
    spread = open_.withColumn("own", own).withColumn("cell", F.explode(sides)).select("bucket", "cell.i", "cell.k", "own", "set_id", "label", "weight", "n_shingles", "sketch")

    def pairs(group: tuple, rows: list[tuple]) -> list[tuple]:
        bucket, i, k = group
        left, right = [r for r in rows if r[0] == i], [r for r in rows if r[0] == k]
        ok = close([r[5] for r in left], [r[5] for r in right], np.array([r[4] for r in left]), np.array([r[4] for r in right]), percent)
        if i == k:
            ok = np.where(np.triu(np.ones(ok.shape, bool), 1), ok, -1)
        ids, label, weight = (np.array([r[j] for r in left]) for j in (1, 2, 3))
        ids2, label2, weight2 = (np.array([r[j] for r in right]) for j in (1, 2, 3))
        x, y = np.nonzero((ok >= 0) & (label[:, None] != label2))
        apart, turn = ok[x, y], (weight[x] > weight2[y]) | ((weight[x] == weight2[y]) & (label[x] > label2[y]))
        few, many, of = np.where(turn, ids2[y], ids[x]), np.where(turn, ids[x], ids2[y]), np.where(turn, label[x], label2[y])
        several = np.ones(len(x), bool)
        if nearest and len(x):
            order = np.lexsort((many, apart, of, few))
            few, many, of = few[order], many[order], of[order]
            first = np.flatnonzero(np.concatenate([[True], (few[1:] != few[:-1]) | (of[1:] != of[:-1])]))
            several = np.diff(np.concatenate([first, [len(x)]])) > 1
            few, many = few[first], many[first]
        return [(a, b, bucket if more else None) for a, b, more in zip(np.minimum(few, many).tolist(), np.maximum(few, many).tolist(), several.tolist(), strict=True)]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["a", "b", "bucket"])

    def run(batches):
        group, rows = None, []
        for b in batches:
            out = []
            columns = [b.column(k).to_pylist() for k in range(9)]
            for g, row in zip(zip(*columns[:3], strict=True), zip(*columns[3:], strict=True), strict=True):
                if g != group:
                    if rows:
                        out += pairs(group, rows)
                    group, rows = g, []
                rows.append(row)
            yield batch(out)
        if rows:
            yield batch(pairs(group, rows))

    dealt = spread.repartition(deals, "bucket", "i", "k").sortWithinPartitions("bucket", "i", "k")
    return dealt.mapInArrow(run, "a long, b long, bucket long")


def node_table(sets: DataFrame, *more: str) -> DataFrame:
    """The distinct sets with a document of each, written."""
    known = sets.where(F.col("set_id").isNotNull())
    return written(known.groupBy("set_id").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n_shingles", "sketch", "narrow", *more))), "nodes")


def classes(docs: DataFrame, sets: DataFrame, nodes: DataFrame, found: DataFrame, deals: int, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles and component_id of the rows of sets, from the buckets (bucket, set_id, members, times) that linked sets share. found is deleted."""
    stars = pivots(found).select(F.least("pivot", "set_id").alias("a"), F.greatest("pivot", "set_id").alias("b"), F.col("pivot").alias("by")).dropDuplicates(["a", "b"])
    seen = written(stars, "pairs")  # checked, or ruled out by their sketches
    links = seen.select("a", "b").limit(0)

    def with_links(pairs: DataFrame) -> DataFrame:
        """The links with those of further pairs."""
        open_ = possible(pairs, nodes, percent)
        kept = written(open_, "pairs")
        dropped(open_, HUBS)
        out = links if kept.isEmpty() else links.unionByName(checked(docs, nodes, kept, deals, size, percent))
        dropped(kept)
        return out

    links = with_links(seen)

    def more_links(looked_at: DataFrame, labels: DataFrame, nearest: bool) -> DataFrame:
        """Checks further pairs of the buckets; gives the nearest pairs, with their bucket, of sets that have others as well."""
        nonlocal links, seen
        rows = written(split_buckets(looked_at, nodes, labels, seen, deals, percent, nearest), "open")
        dropped(labels)
        more = written(rows.select("a", "b").distinct().join(seen, ["a", "b"], "left_anti").withColumn("by", F.col("a")), "pairs")
        several = written(rows.where("bucket IS NOT NULL"), "several")
        dropped(rows)
        links, seen = with_links(more), seen.unionByName(more)
        return several

    several = more_links(found, united(links, "a", "b"), nearest=True)
    if not several.isEmpty():
        labels = united(links, "a", "b")
        of = lambda k: labels.select(F.col("node").alias(k), F.col("label").alias(f"label_{k}"))
        apart = F.coalesce("label_a", "a") != F.coalesce("label_b", "b")
        left = written(several.join(of("a"), "a", "left").join(of("b"), "b", "left").where(apart).select("bucket").distinct(), "left")
        if not left.isEmpty():
            again = written(found.join(left, "bucket", "left_semi"), "again")  # is read twice
            dropped(more_links(again, labels, nearest=False))
            dropped(again)
        dropped(labels)
        dropped(left)
    for table in (several, found, seen):
        dropped(table)

    rep = nodes.select("set_id", "rep")
    labels = united(links, "a", "b")
    of_set = rep.join(labels, rep["set_id"] == labels["node"], "left").select("set_id", "rep", F.coalesce("label", "set_id").alias("class"))
    least = of_set.groupBy("class").agg(F.min("rep").alias("component_id"))
    of_set = of_set.join(least, "class").select("set_id", "component_id")
    every = sets.select("doc_id", "n_shingles", "set_id").join(of_set, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = written(every, "classes")
    for table in (links, labels, sets, nodes):
        dropped(table)
    return out


def deals_of(sets: DataFrame) -> int:
    """Tasks of about DEAL_SHINGLES each."""
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    return max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // DEAL_SHINGLES))


def linked_documents(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every row."""
    sets = written(set_table(docs, size), "sets")
    deals, nodes = deals_of(sets), node_table(sets)
    found = written(buckets(packed_pieces(docs, deals, size, percent), deals), "buckets")
    return classes(docs, sets, nodes, found, deals, size, percent)


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component, the one of least doc_id, and one row of it, that of the least text. Rows without doc_id stay."""
    linked = linked_documents(docs, size, percent)
    rows = written(linked.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("first"), F.count(F.lit(1)).alias("n")), "kept")
    gone = rows.where(~F.col("first")).select("doc_id")
    kept = docs.join(broadcast_if_small(gone, F.lit(24)), "doc_id", "left_anti")
    repeated = rows.where("first AND n > 1").select("doc_id")
    if not repeated.isEmpty():
        repeated = broadcast_if_small(repeated, F.lit(24))
        whole, order = F.struct(*docs.columns), F.struct(text_column(docs), F.xxhash64(*docs.columns))
        single = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(whole, order).alias("row")).select("row.*")
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(single)
    return kept.select(*docs.columns)
