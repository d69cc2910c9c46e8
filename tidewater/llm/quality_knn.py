"""Quality by votes of nearest neighbours in a latent semantic space.

Terms of a text are hashed to TERMS columns: words, three-character shapes (letters by case, digits,
blanks, each mark as itself) and signs of repetition (a word like the one before, a line seen
before). Weights are log counts times inverse document frequency; a truncated SVD of the labelled
sample gives AXES latent axes. Labelled vectors are broadcast (at most 2 x PER_CLASS of them), every
document is compared with all of them in exact blocked cosine products, and the NEIGHBOURS nearest
vote with their similarity.

Weights, axes and latent vectors are rounded to steps (WEIGHT_STEP, LATENT_STEP) whose products and
sums floats hold exactly. So a text's score depends on the text alone: not on the block, batch or
task that it comes in, nor on the order in which sums are taken.

The sample of labelled rows is the only bounded part; every whole text is scored, in slices of about
1 MB, in one pass without shuffle.

Edge cases: a null or empty text, or one that shares no term with the sample, scores the share of
label 1 among the labelled rows drawn; of equal similarities the lower sample row is nearer; equal
texts score alike; of repeated doc_ids the fit takes the least text and label; an empty table gives no rows; without labels of both classes the score is that of the
one class, or 0.5; only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_rows, per_text
from .hashing import U64, Words, mix, slices
from .labels import held_out, sample

PER_CLASS = 1500
WORD_TERMS = 2048
SHAPE_TERMS = 2048
SIGNS = 2
TERMS = WORD_TERMS + SHAPE_TERMS + SIGNS
AXES = 64
NEIGHBOURS = 15
SHARPNESS = 4
#: Term weights and axes are below 1: their products have 40 bits, exact in double precision.
WEIGHT_STEP = 1 << 20
#: Products of two latent vectors, and all sums on the way, stay below 2 ** 24: exact in single precision.
LATENT_STEP = 4000
MODULUS, REST = 3, 1


def shape_classes() -> np.ndarray:
    out = np.arange(256, dtype=np.int64)
    out[ord("a") : ord("z") + 1] = out[128:] = ord("a")
    out[ord("A") : ord("Z") + 1] = ord("A")
    out[ord("0") : ord("9") + 1] = ord("0")
    out[[9, 11, 12, 13]] = ord(" ")
    return out


SHAPES = shape_classes()


def term_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of every hashed term, a row for each text. Shapes may take in the blank after the text, but nothing of the next one."""
    n, words = len(texts), Words(texts)
    of = np.repeat(np.arange(n), words.counts())
    out = np.zeros((n, TERMS), np.float32)
    out[:, :WORD_TERMS] = np.bincount(of * WORD_TERMS + (words.codes % U64(WORD_TERMS)).astype(np.int64), minlength=n * WORD_TERMS).reshape(n, -1)
    shape = SHAPES[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    if len(shape) > 2:
        run = (shape[:-2] << 16 | shape[1:-1] << 8 | shape[2:]).astype(U64)
        owner = np.repeat(np.arange(n), np.diff(words.begins))
        own = owner[2:] == owner[:-2]
        run, owner = run[own], owner[:-2][own]
        out[:, WORD_TERMS : WORD_TERMS + SHAPE_TERMS] = np.bincount(owner * SHAPE_TERMS + (mix(run) % U64(SHAPE_TERMS)).astype(np.int64), minlength=n * SHAPE_TERMS).reshape(n, -1)
    again = (words.codes[1:] == words.codes[:-1]) & (of[1:] == of[:-1])
    out[:, -2] = np.bincount(of[1:][again], minlength=n)
    for k, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip()]
        out[k, -1] = len(lines) - len(set(lines))
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(counts.astype(np.float64)) * idf
    return np.rint(out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9) * WEIGHT_STEP) / WEIGHT_STEP


def latent(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors on the axes, in whole numbers of LATENT_STEP; zeros for texts without a known term."""
    out = x @ axes
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.where(length > 1e-6, np.rint(out / np.maximum(length, 1e-9) * LATENT_STEP), 0).astype(np.float32)


def fit(counts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Term weights, latent axes, and the labelled vectors."""
    if not len(labels):
        counts = np.zeros((0, TERMS), np.float32)
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    x = weighted(counts, idf)
    axes = min(AXES, max(1, len(x)))
    rng = np.random.default_rng(7)
    basis = rng.standard_normal((TERMS, axes + 16))
    for _ in range(4):  # subspace iteration: the leading right singular vectors
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    small = x @ basis
    _, _, turn = np.linalg.svd(small, full_matrices=False) if len(x) else (0, 0, np.eye(axes, axes + 16))
    project = np.rint(basis @ turn.T[:, :axes] * WEIGHT_STEP) / WEIGHT_STEP
    return {"idf": idf, "axes": project, "vectors": latent(x, project), "labels": labels.astype(np.float64)}


def vote(model: dict[str, np.ndarray], texts: list[bytes]) -> np.ndarray:
    """Scores from 0 to 1."""
    labels = model["labels"]
    share = float(labels.mean()) if len(labels) else 0.5
    out = np.full(len(texts), share)
    if not len(labels):
        return out
    k, n = min(NEIGHBOURS, len(labels)), len(labels)
    for a, b in slices(texts):
        for c in range(a, b, 256):
            some = texts[c : min(b, c + 256)]
            own = latent(weighted(term_counts(some), model["idf"]), model["axes"])
            # similarity, then the lower row, in one whole number
            order = (own @ model["vectors"].T).astype(np.int64) * n + np.arange(n - 1, -1, -1)
            near = np.sort(np.partition(order, n - k, axis=1)[:, n - k :], axis=1)[:, ::-1]
            cosine, row = near // n, n - 1 - near % n
            weight = (np.maximum(cosine, 0) / LATENT_STEP**2) ** SHARPNESS
            total = weight.sum(axis=1)
            usable = (total > 0) & np.array([bool(t.strip()) for t in some])
            voted = (weight * labels[row]).sum(axis=1) / np.where(total > 0, total, 1)
            out[c : c + len(some)] = np.where(usable, np.clip(voted, 0, 1), share)
    return out


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict[str, np.ndarray]:
    """The model of the labelled sample; terms are counted where the texts are, the bounded sample comes to the driver sparse."""

    def terms(texts: list[str]):
        rows = [term_counts([t.encode()])[0] for t in texts]
        at = [np.flatnonzero(r) for r in rows]
        return [a.astype("<u2").tobytes() for a in at], [r[a].astype("<f4").tobytes() for a, r in zip(at, rows, strict=True)]

    drawn = sample(docs, labels, "quality", MODULUS, REST, per_class)
    both = drawn.select(F.struct("doc_id", "label").alias("key"), "text")
    found = sorted(per_text(both, "at binary, counts binary", terms, key="key").collect(), key=lambda r: r.key.doc_id)
    counts = np.zeros((len(found), TERMS), np.float32)
    for k, r in enumerate(found):
        counts[k, np.frombuffer(r.at, "<u2")] = np.frombuffer(r.counts, "<f4")
    return fit(counts, np.array([r.key.label for r in found]))


def scored(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, per_class))
    out = per_text(docs, "score double", lambda texts: [vote(model.value, [t.encode() for t in texts])])
    return out.select("doc_id", held_out(F.col("doc_id"), MODULUS, REST).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_only(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose text the vote rejects."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))
    return kept_rows(docs, lambda texts: vote(model.value, [t.encode() for t in texts]) >= 0.5)
