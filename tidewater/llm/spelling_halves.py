"""Grouping of spelling variants by Aho-Corasick automata over word halves.

A word is cut in a first half of length // 2 code points and the rest. If two words differ by one
inserted, deleted or replaced code point, one of these segments of either word is whole in the
other: the first at its begin, the rest at its end. So every word's two segments go to automaton
shards, all words are scanned by them, and a hit counts where it stands at the begin (first half) or
at the end (rest) and the words' lengths differ by one at most. Then the distance is verified: the
longest common begin and end of the two must cover all but one code point of the longer word.

Segments and words are dealt by the SEED code points at the word's begin, and at its end, so a word
is only scanned by automata that can hold something for it. A seed of more than PATTERNS words is cut
by word in as many automata as it needs, and its words are scanned by each. A task holds the segments
of its automaton; scanned words stream by. A pair that both segments find counts for the first only,
so counts add up without a shuffle of pairs: each shard sends one row a word, its number of near
words and the best of them.

Roots: pointers double in each round, as a form has at least FACTOR times its word's n, so a chain
is short and few rounds are needed. Each round is a written table, the one before is deleted.

Edge cases: a null text has no words; a null doc_id reads as an empty text before the colon of the
hashed string; repeated rows each count; runs of any length are words like others (those over WIDTH
are compared one by one); equal n: the near word that is first in code-point order; empty tables
give no rows; only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, dropped, pieces, small_batches, text_column, written

#: Fixed by the query's contract.
LETTERS = "a-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, FACTOR, MODULUS = 6, 5, 5, 199

SEED = 3  # at most half of MIN_LENGTH, so that every segment holds its seed
#: Words of one seed in one automaton, and words of all seeds in one task, about.
PATTERNS, SHARD_WORDS = 20_000, 50_000
#: Distinct words that a counting task holds before it sends their counts on.
HELD_WORDS = 200_000
#: Code points of words that are compared as rows of a matrix; pairs that are compared at a time.
WIDTH, PAIRS = 48, 250_000

LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n, by how often it occurs, of all words of at least MIN_LENGTH code points and MIN_COUNT occurrences."""
    run_of_letters = re.compile(f"[{LETTERS}]{{{MIN_LENGTH},}}")  # a shorter run is no word, whatever is deleted

    def counts(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        held: Counter = Counter()
        for b in pieces(batches):
            for key, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                begun = zlib.crc32(f"{key}:".encode())
                for word, n in Counter(run_of_letters.findall(text.translate(LOWER).decode())).items():
                    h = zlib.crc32(word.encode(), begun)
                    if h % MODULUS == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < MIN_LENGTH:
                            continue
                    held[word] += n
                if len(held) >= HELD_WORDS:
                    yield counts(held)
                    held = Counter()
        yield counts(held)

    small_batches(docs)
    some = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), text_column(docs).alias("text")).mapInArrow(run, "word string, n long")
    return some.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def one_edit(a: str, b: str) -> bool:
    """Whether two different words differ by one code point inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > 1:
        return False
    longer, shorter = (a, b) if len(a) >= len(b) else (b, a)
    k = next((k for k, (x, y) in enumerate(zip(longer, shorter, strict=False)) if x != y), len(shorter))
    return longer[k + 1 :] == shorter[k + (len(longer) == len(shorter)) :]


class Matrix:
    """Words as rows of code points, from the begin and from the end; words over WIDTH have no row of use."""

    def __init__(self, words: list[str]):
        self.words = words
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        raw = b"".join(w.encode("latin-1")[:WIDTH].ljust(WIDTH, b"\0") for w in words)
        back = b"".join(w[::-1].encode("latin-1")[:WIDTH].ljust(WIDTH, b"\0") for w in words)
        self.begin, self.end = (np.frombuffer(x, np.uint8).reshape(-1, WIDTH) for x in (raw, back))


def same_begin(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common begins of rows."""
    unlike = a != b
    return np.where(unlike.any(axis=1), unlike.argmax(axis=1), a.shape[1])


class Shard:
    """An automaton of the segments of some words."""

    def __init__(self, group: np.ndarray, first: np.ndarray, words: list[str], n: np.ndarray):
        import ahocorasick

        self.group, self.first, self.n, self.matrix = group, first, n, Matrix(words)
        self.rank = np.empty(len(words), np.int64)
        self.rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        self.half = self.matrix.length // 2
        holders: dict[tuple[str, bool], list[int]] = {}
        for k, (w, is_first) in enumerate(zip(words, first.tolist(), strict=True)):
            half = len(w) // 2
            holders.setdefault((w[:half] if is_first else w[half:], is_first), []).append(k)
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in holders.values()])]).astype(np.int64)
        self.holders = np.concatenate([np.array(x, np.int64) for x in holders.values()])
        at: dict[str, list[int]] = {}
        for k, (segment, is_first) in enumerate(holders):
            at.setdefault(segment, [-1, -1])[not is_first] = k
        self.automaton = ahocorasick.Automaton()
        for segment, (begins, ends) in at.items():
            self.automaton.add_word(segment, (len(segment), begins, ends))
        self.automaton.make_automaton()

    def near(self, group: np.ndarray, first: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the scanned words that have a near word here: their places, how many, and the one of largest n."""
        of, lists = [], []
        for k, (w, is_first) in enumerate(zip(words, first.tolist(), strict=True)):
            last = len(w) - 1
            for end, (length, begins, ends) in self.automaton.iter(w):
                hit = (begins if end + 1 == length else -1) if is_first else (ends if end == last else -1)
                if hit >= 0:
                    of.append(k)
                    lists.append(hit)
        scanned, own, others = Matrix(words), [], []
        of_, lists_ = np.array(of, np.int64), np.array(lists, np.int64)
        size = self.starts[lists_ + 1] - self.starts[lists_] if len(lists_) else np.zeros(0, np.int64)
        cuts = np.unique(np.concatenate([[0], np.searchsorted(np.cumsum(size), np.arange(PAIRS, size.sum(), PAIRS)) + 1, [len(size)]])) if len(size) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            m = size[a:b]
            y = np.repeat(of_[a:b], m)
            x = self.holders[np.repeat(self.starts[lists_[a:b]] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())]
            keep = (np.abs(self.matrix.length[x] - scanned.length[y]) <= 1) & (self.group[x] == group[y])
            x, y = x[keep], y[keep]
            begin = same_begin(self.matrix.begin[x], scanned.begin[y])
            longer = np.maximum(self.matrix.length[x], scanned.length[y])
            begin = np.minimum(begin, np.minimum(self.matrix.length[x], scanned.length[y]))
            ok = (begin + same_begin(self.matrix.end[x], scanned.end[y]) >= longer - 1) & (first[y] | (begin < self.half[x]))
            for k in np.flatnonzero(longer > WIDTH):
                v, w = self.matrix.words[x[k]], words[y[k]]
                ok[k] = v != w and one_edit(v, w) and (first[y[k]] or not w.startswith(v[: len(v) // 2]))
            ok &= (longer > WIDTH) | (self.matrix.length[x] != scanned.length[y]) | (begin < longer)  # not the word itself
            own.append(y[ok])
            others.append(x[ok])
        y, x = (np.concatenate([*v, np.zeros(0, np.int64)]) for v in (own, others))
        order = np.lexsort((self.rank[x], -self.n[x], y))
        y, x = y[order], x[order]
        at = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]])) if len(y) else np.zeros(0, np.int64)
        return y[at], np.diff(np.concatenate([at, [len(y)]])), x[at]


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, and best_n and best, the near word of largest n, of the words (word, n) that have a near one."""
    total = words.count()
    shards = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // SHARD_WORDS))
    seeds = F.array(F.struct(F.lit(True).alias("first"), F.substring("word", 1, SEED).alias("seed")), F.struct(F.lit(False).alias("first"), F.substring("word", -SEED, SEED).alias("seed")))
    seeded = words.select("word", "n", F.inline(seeds))
    many = written(seeded.groupBy("first", "seed").agg(F.ceil(F.count(F.lit(1)) / PATTERNS).cast("int").alias("cuts")).where("cuts > 1"), "seeds")
    cut = seeded.join(broadcast_if_small(many, F.lit(64)), ["first", "seed"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    group = lambda part: F.xxhash64("first", "seed", part)
    segments = cut.select(F.lit(0).alias("role"), group(F.pmod(F.xxhash64("word"), "cuts").cast("int")).alias("group"), "first", "word", "n")
    scans = cut.select("first", "seed", "word", "n", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("part")).select(F.lit(1).alias("role"), group(F.col("part")).alias("group"), "first", "word", "n")
    names = ["word", "n_near", "best_n", "best"]

    def run(batches):
        held: list[pa.RecordBatch] = []
        shard = None
        for b in batches:
            k = int((b.column(0).to_numpy() == 0).sum())  # a task's segments come first
            if k:
                held.append(b.slice(0, k))
            if k == b.num_rows:
                continue
            if shard is None:
                if not held:
                    return
                own = pa.Table.from_batches(held)
                shard = Shard(own.column(1).to_numpy(), own.column(2).to_numpy(), own.column(3).to_pylist(), own.column(4).to_numpy())
                held, own = [], None
            b = b.slice(k)
            words_ = b.column(3).to_pylist()
            at, n, best = shard.near(b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False), words_)
            yield pa.RecordBatch.from_arrays([pa.array([words_[i] for i in at], pa.string()), pa.array(n, pa.int64()), pa.array(shard.n[best], pa.int64()), pa.array([shard.matrix.words[i] for i in best], pa.string())], names=names)

    dealt = segments.unionByName(scans).repartition(shards, "group").sortWithinPartitions("role")
    some = dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return some.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("least")).select("word", "n_near", (-F.col("least.less")).alias("best_n"), "least.best")


def roots(forms: DataFrame) -> DataFrame:
    """word and root, the last form from word on, of the written rows (word, form) that have a form."""
    now = written(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.where("moved").isEmpty():
        further = broadcast_if_small(now.select(F.col("word").alias("root"), F.col("root").alias("next")), F.octet_length("root") + F.octet_length("next") + 32)
        after = written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        dropped(now)
        now = after
    return now.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form (its near word of largest n, if that is at least FACTOR times its own; else null), root, n, n_near and form_n of every word."""
    words = written(word_counts(docs), "words")
    shown = F.col("best_n") >= FACTOR * F.col("n")
    near = near_words(words)
    found = words.join(near, "word", "left").select(
        "word", F.when(shown, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(shown, F.col("best_n")).alias("form_n")
    )
    forms = written(found, "forms")
    dropped(near)  # and the words, which it reads
    return forms.join(roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
