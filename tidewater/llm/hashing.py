"""Word and shingle codes of many texts at once, in numpy.

A word's 64-bit code is a polynomial of its bytes, from running sums over the joined buffer: no
loop over words or characters. Buffers are cut to about SLICE_BYTES, so memory stays small for any
batch; a longer single text makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE_BYTES = 1 << 19
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads codes over all 64 bits (the finalizer of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** k and its inverse for k < n at least."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _powers["up"] = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(size - 1, BASE)]))
            _powers["down"] = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(size - 1, BASE_INVERSE)]))
    return _powers["up"][:n], _powers["down"][:n]


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SLICE_BYTES."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > SLICE_BYTES:
            yield start, k
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


class Words:
    """Words of some texts: codes, the text each stands in, and where it begins and ends in the buffer."""

    def __init__(self, texts: list[bytes], lower: bool = True, blank: np.ndarray = BLANK):
        buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        if lower:
            buf = np.where((buf >= 65) & (buf <= 90), buf | 32, buf)
        self.buffer = buf
        gap = blank[buf]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1 if len(buf) else np.zeros(0, np.int64)
        if len(buf) and not gap[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[::2], edge[1::2]  # the buffer ends with a blank
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.begins = np.concatenate([[0], np.cumsum(lengths)])  # of texts
        self.first = np.searchsorted(self.starts, self.begins)  # first word of each text
        up, down = powers(len(buf) + 1)
        with np.errstate(over="ignore"):
            run = self.run = np.concatenate([np.zeros(1, U64), np.cumsum(BYTE_CODES[buf] * up[: len(buf)], dtype=U64)])
            self.codes = mix((run[self.ends] - run[self.starts]) * down[self.starts])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def shingles(words: Words, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle codes of each text. A text of fewer words is one shingle, one without words has none."""
    codes, n = words.codes, len(words.codes)
    with np.errstate(over="ignore"):
        weights = powers(size)[0]
        whole = mix(sum((codes[k : n - size + 1 + k] * weights[k] for k in range(size)), np.full(n - size + 1, U64(1)))) if n >= size else np.zeros(0, U64)
    out = []
    for start, end in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if end - start >= size:
            own = np.sort(whole[start : end - size + 1])
            fresh = np.empty(len(own), bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            out.append(own[fresh])
        elif end > start:
            code = sum(int(c) * pow(int(BASE), k, 1 << 64) for k, c in enumerate(codes[start:end])) + ((end - start) << 56)
            out.append(mix(np.array([code & (1 << 64) - 1], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """Shingle sets of any number of texts, slice by slice."""
    for a, b in slices(texts):
        yield from shingles(Words(texts[a:b]), size)
