"""Spelling variants, product codes and SuperMinHash against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_operators import ODD, jaccard_components

from tidewater.llm import common, grouping, parity_join, spelling_halves, superminhash, yinyang_codes


def brute_words(rows):
    n = Counter()
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for run in re.findall("[a-zA-ZÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 5}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_variants(rows):
    n = brute_words(rows)
    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) <= 1 and edits(v, w) == 1] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("way", ["broadcast", "cut"])
def test_spelling_variants(make_docs, monkeypatch, way):
    if way == "cut":
        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
        for name, value in (("PATTERNS", 3), ("SHARD_WORDS", 10), ("HELD_WORDS", 20), ("PAIRS", 7)):
            monkeypatch.setattr(spelling_halves, name, value)
    rnd = random.Random(11)
    base = ["".join(rnd.choice("abé") for _ in range(rnd.randint(6, 9))) for _ in range(12)] + ["z" * 60, "z" * 59 + "y", "z" * 61, "zy" * 24, "zy" * 24 + "z"]

    def bent(w):
        k = rnd.randrange(len(w))
        return rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice("abÉ") + w[k:], w[:k] + rnd.choice("abé") + w[k + 1 :]])

    words = []
    for w in base:
        words += [w] * rnd.choice([8, 40, 200])
        for _ in range(6):
            v = bent(w)
            words += [v] * rnd.choice([2, 5, 8, 40])
            words += [bent(v)] * rnd.choice([5, 6])
    rnd.shuffle(words)
    rows = [(k, " ".join(words[k * 9 : k * 9 + 9]).upper() if k % 5 == 0 else ", ".join(words[k * 9 : k * 9 + 9])) for k in range(len(words) // 9 + 1)]
    rows += ODD + [(None, "second thoughts second")] * 6
    out = sorted(tuple(r) for r in spelling_halves.spelling_variants(make_docs(rows)).collect())
    want = brute_variants(rows)
    assert out == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] for r in want if r[1])


def test_spelling_of_nothing(make_docs):
    assert spelling_halves.spelling_variants(make_docs([])).count() == 0
    assert spelling_halves.spelling_variants(make_docs(ODD)).count() == 0


def test_one_edit():
    rnd = random.Random(2)
    for _ in range(4000):
        a, b = ("".join(rnd.choice("ab") for _ in range(rnd.randint(1, 6))) for _ in range(2))
        if a != b:
            assert spelling_halves.one_edit(a, b) == (edits(a, b) == 1)


def brute_codes(rows, rounds=6):
    kept = [(i, v, k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = max(8, -(-max(len(v) for _, v, _ in kept) // 8) * 8)
    whole = lambda x: math.floor(x * 4096) if abs(x) < 1e290 else int(x) * 4096
    ints = [[whole(x) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    w = width // 8
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:16]
    books = [[ints[k][p * w : p * w + w] for k in order] for p in range(8)]
    parts = [[row[p * w : p * w + w] for p in range(8)] for row in ints]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda: [[min((dist(row[p], e), j) for j, e in enumerate(books[p])) for p in range(8)] for row in parts]
    for _ in range(rounds):
        at = nearest()
        for p in range(8):
            for j in range(len(books[p])):
                own = [parts[r][p] for r in range(len(parts)) if at[r][p][1] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    at = nearest()
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    most = (1 << 63) - 1
    errors = [min(sum(d for d, _ in row), most) for row in at]
    sums = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        sums[label] += e
    out = [(i, "".join(f"{j:02x}" for _, j in row), e, sums[label] if sums[label] <= most else None, sha) for (i, _, label), row, e in zip(kept, at, errors, strict=True)]
    return sorted(out, key=repr)


def coded(spark, rows):
    df = spark.createDataFrame([(i, v, k, "x") for i, v, k in rows], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    return sorted((tuple(r) for r in yinyang_codes.vector_codes(df).collect()), key=repr)


@pytest.mark.parametrize("kind", ["plain", "ties", "huge", "few"])
def test_vector_codes(spark, kind):
    rnd = random.Random(kind)
    if kind == "plain":
        rows = [(k, [rnd.gauss(rnd.choice([-1, 0, 1]) * (k % 3), 0.3) for _ in range(16)], rnd.choice([0, 1, None])) for k in range(400)]
    elif kind == "ties":  # few values, so that very many distances are equal
        rows = [(k, [rnd.choice([0.0, 1 / 4096, 2 / 4096]) for _ in range(8)], 1) for k in range(300)]
    elif kind == "huge":
        rows = [(k, [rnd.choice([1e300, -1e30, 5e3, 1.7e308, 0.25]) * rnd.random() for _ in range(16)], k % 2) for k in range(60)]
    else:
        rows = [(k, [rnd.random() for _ in range(8)], None) for k in range(5)]
    inf, nan = float("inf"), float("nan")
    rows += [(1000, None, 1), (1001, [inf] * 8, 1), (1002, [nan, 1.0], 1), (1003, [None, 1.0], 1), (1004, [], 2), (1005, [1.0, 2.0, 3.0], 2), (None, [0.5] * 8, None), (3, rows[3][1], 0), (3, rows[3][1], 0)]
    assert coded(spark, rows) == brute_codes(rows)


def test_codes_of_nothing(spark):
    assert coded(spark, []) == []
    assert coded(spark, [(1, None, 1), (2, [float("nan")], 1)]) == []


def test_bounds_skip_work():
    """The bounds leave out most distances once entries settle, and never change an assignment."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-4000, 4000, (1, 32)) + rng.integers(-150, 150, (400, 32)) for _ in range(20)])
    books = yinyang_codes.Codebooks(np.ascontiguousarray(x[rng.permutation(len(x))[:16]].reshape(16, 8, 4).swapaxes(0, 1)))
    at, low = np.full((len(x), 8), yinyang_codes.NONE, np.uint8), np.zeros((len(x), 8, yinyang_codes.GROUPS), np.uint16)
    taken = []
    for _ in range(7):
        at, error, low, n = yinyang_codes.assigned(x, books, at, low)
        taken.append(n)
        sums = yinyang_codes.Sums(32, 3)
        for p in range(8):
            d = yinyang_codes.squares(x[:, p * 4 : p * 4 + 4], books.entries[p])
            assert np.array_equal(at[:, p], d.argmin(axis=1)) and np.array_equal(error[:, p], d.min(axis=1))
        sums.add(x, at)
        books = books.moved(yinyang_codes.Sums.means(dict(enumerate(sums.row())), books.entries, 3))
    assert taken[0] == len(x) * 8 * 16 and taken[-1] < taken[0] / 3


@pytest.mark.parametrize("way", ["broadcast", "shuffled"])
def test_near_duplicates(make_docs, prose, monkeypatch, way):
    if way == "shuffled":
        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(grouping, "LINKS", 3)
        for name in ("BLOCK", "BUCKET_BLOCK"):
            monkeypatch.setattr(parity_join, name, 4)
    rnd = random.Random(13)
    rows = []
    for group in range(14):
        base = prose(group + 50, rnd.choice([2, 5, 6, 9, 14, 30, 80, 200])).split()
        for _ in range(rnd.randint(1, 14)):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 8])):
                copy[rnd.randrange(len(copy))] = rnd.choice(["zig", "zag", "ZOG"])
            if rnd.random() < 0.2:
                copy += [f"tail{k}" for k in range(rnd.randint(1, 8))]
            rows.append((len(rows) + 10, " ".join(copy)))
    rows += ODD + [(9, prose(5, 9000)), (9, prose(6, 60)), (5000, prose(5, 9000) + " end")]
    out = superminhash.near_duplicates(make_docs(rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == jaccard_components(rows, 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    few = superminhash.near_duplicates(make_docs([(1, "a b c"), (None, "a b c"), (None, None)])).collect()
    assert sorted((r.doc_id is None, r.component_id or 0, r.kept) for r in few) == [(False, 1, True), (True, 0, True), (True, 1, False)]
    assert superminhash.near_duplicates(make_docs([])).count() == 0


def slow_signature(codes):
    """Each element's whole permutation, without stopping early."""
    out = [None] * superminhash.SLOTS
    for c in codes:
        order = list(range(superminhash.SLOTS))
        for j in range(superminhash.SLOTS):
            offer, rank = (int(v[0]) for v in superminhash.draws(np.array([c], np.uint64), j))
            order[j], order[rank] = order[rank], order[j]
            if out[order[j]] is None or offer < out[order[j]]:
                out[order[j]] = offer
    return out


def test_signatures():
    """Equal to the definition, and slots agree about as often as the sets' similarity says, with less spread than independent hashes."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 2, 7, 60, 900)]
    got = superminhash.signatures([*sets, np.zeros(0, np.uint64)])
    for s, row in zip(sets, got, strict=False):
        assert row.tolist() == slow_signature(s.tolist())
    assert (got[-1] == ~np.uint64(0)).all()
    off = []
    for _ in range(200):
        every = rng.integers(0, 1 << 63, 120).astype(np.uint64)
        a, b = superminhash.signatures([np.sort(every[:110]), np.sort(every[10:])])
        off.append((a == b).mean() - 100 / 120)
    assert abs(np.mean(off)) < 0.01
    assert np.std(off) < 0.9 * math.sqrt(100 / 120 * 20 / 120 / superminhash.SLOTS)


@pytest.mark.parametrize("at_once", [7, 1000])
def test_union_find(spark, monkeypatch, at_once):
    monkeypatch.setattr(grouping, "LINKS", at_once)
    rnd = random.Random(1)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)]
    got = {r.node: r.label for r in grouping.united(spark.createDataFrame(links, "a long, b long").repartition(5), "a", "b").collect()}
    label = list(range(300))
    for _ in range(300):
        for x, y in links:
            label[x] = label[y] = min(label[x], label[y])
    assert got == {x: label[x] for pair in links if pair[0] != pair[1] for x in pair}
