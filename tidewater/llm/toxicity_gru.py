"""Toxicity by a bidirectional gated recurrent network over words and their characters.

A word's input is the embedding of its hash, plus those of its beginnings and endings of a few
characters, plus the mean of those of all its runs of INNER characters; so unseen words with telling
parts count. Two gated recurrent layers read a window of WINDOW words in both directions, attention
pools their states, and a linear unit gives the window's logit. Windows overlap by half and cover the
whole text; a document scores by its strongest window, scaled to a probability on the training
documents.

Trained in one task, in numpy, with Adam on at most 2 x PER_CLASS labelled documents, first on windows drawn from all,
then on each document's strongest one, as a toxic document need not be toxic throughout. The
strongest come from CANDIDATES windows of each document, which are chosen from all of its windows
every REFRESH epochs. Batches are smaller and epochs more for smaller samples, so that few labels get enough steps.
Scoring is one pass over all texts without shuffle; inputs to the gates are computed once for each
distinct word of a slice.

Edge cases: null or empty texts, or texts of marks only, are one window without words, whose score
is 0; repeated rows score alike; very long texts are scored whole, window by window; of equal training windows the first is the
strongest, and a score of 0.5 is toxic; an empty table gives no rows; without labels of both classes every
score is 0; only doc_id and text are read.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_rows, per_text, small_batches
from .hashing import U64, Words, mix, powers, slices
from .labels import held_out, sample

PER_CLASS = 1500
CANDIDATES, REFRESH = 4, 5
WINDOW, STRIDE = 32, 16
WORD_ROWS, GRAM_ROWS = 1 << 14, 1 << 15
#: Characters of the beginnings, of the endings and of the runs anywhere that a word is read by.
BEGINNINGS, ENDINGS, INNER = (3, 4, 5, 6), (3, 4), 4
INPUT, HIDDEN, ATTEND = 16, 8, 8
EPOCHS_ALL, EPOCHS_TOP, RATE = 6, 14, 0.01
#: A sample of fewer texts than ENOUGH is gone through more often on its strongest windows, up to EPOCHS_FEW times.
ENOUGH, EPOCHS_FEW = 1000, 40
#: Windows of a training step: this, or fewer for a sample of few documents.
BATCH, STEPS_AN_EPOCH = 256, 12
MODULUS, REST = 5, 0
#: Words are runs of letters and digits; bytes beyond ASCII count as letters.
MARKS = np.array([not (chr(k).isalnum() and k < 128 or k >= 128) for k in range(256)])


class Inputs:
    """Distinct words of some texts as rows of the embedding tables, and all texts' windows over them."""

    def __init__(self, texts: list[bytes]):
        words = Words(texts, blank=MARKS)
        codes, first, self.of_word = np.unique(words.codes, return_index=True, return_inverse=True)
        start, end = words.starts[first], words.ends[first]
        begins = np.append((words.buffer & 0xC0) != 0x80, True)  # a character begins
        at = np.flatnonzero(begins)  # where each character begins
        nth = np.cumsum(begins) - 1
        low, high = nth[start], nth[end]  # first character, and the one after the last
        spans = [(start, at[np.minimum(low + n, high)], n) for n in BEGINNINGS] + [(at[np.maximum(high - n, low)], end, 100 + n) for n in ENDINGS]
        down = powers(len(words.buffer) + 1)[1]
        with np.errstate(over="ignore"):
            row = lambda a, b, kind: (mix((words.run[b] - words.run[a]) * down[a] + U64(kind)) % U64(GRAM_ROWS)).astype(np.int64)
            self.grams = np.stack([row(a, b, k) for a, b, k in spans], axis=1)
            self.n_inner = np.maximum(high - low - INNER + 1, 0)
            inner = np.repeat(low - (np.cumsum(self.n_inner) - self.n_inner), self.n_inner) + np.arange(self.n_inner.sum())
            self.inner = row(at[inner], at[inner + INNER], 200)
        self.words = (codes % U64(WORD_ROWS)).astype(np.int64)
        counts = words.counts()
        per = np.where(counts > 0, np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1), 0)
        self.text = np.repeat(np.arange(len(texts)), per)
        nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        begin = words.first[:-1][self.text] + nth * STRIDE
        self.sizes = np.minimum(WINDOW, words.first[1:][self.text] - begin)
        at = begin[:, None] + np.arange(WINDOW)
        padded = np.append(self.of_word, len(codes))
        self.windows = np.where(np.arange(WINDOW) < self.sizes[:, None], padded[np.minimum(at, len(self.of_word))], len(codes))


class Merged(Inputs):
    """The same over any number of texts, read slice by slice to bound memory; a word may have a row for each slice."""

    def __init__(self, texts: list[bytes]):
        parts = [(a, Inputs(texts[a:b])) for a, b in slices(texts)]
        sizes = np.array([len(x.words) for _, x in parts])
        total, before = int(sizes.sum()), np.cumsum(sizes) - sizes
        self.words = np.concatenate([x.words for _, x in parts])
        self.grams = np.concatenate([x.grams for _, x in parts])
        self.n_inner, self.inner = np.concatenate([x.n_inner for _, x in parts]), np.concatenate([x.inner for _, x in parts])
        self.text = np.concatenate([x.text + a for a, x in parts])
        self.sizes = np.concatenate([x.sizes for _, x in parts])
        self.windows = np.concatenate([np.where(x.windows == n, total, x.windows + k) for (_, x), n, k in zip(parts, sizes, before, strict=True)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def new_parameters(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {
        "word": draw(WORD_ROWS, INPUT, scale=0.1),
        "gram": draw(GRAM_ROWS, INPUT, scale=0.1),
        "in": draw(INPUT, 6 * HIDDEN, scale=INPUT**-0.5),
        "in_bias": np.zeros(6 * HIDDEN, np.float32),
        "back_f": draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
        "back_b": draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
        "attend": draw(2 * HIDDEN, ATTEND, scale=(2 * HIDDEN) ** -0.5),
        "attend_bias": np.zeros(ATTEND, np.float32),
        "focus": draw(ATTEND, scale=ATTEND**-0.5),
        "out": draw(2 * HIDDEN, scale=(2 * HIDDEN) ** -0.5),
        "out_bias": np.zeros(1, np.float32),
    }


def embedded(p: dict[str, np.ndarray], x: Inputs, some: np.ndarray | None = None) -> np.ndarray:
    """A row for each word, or each of some, and one of zeros for the padding."""
    words, grams, inner, count = x.words, x.grams, x.inner, x.n_inner
    if some is not None:
        inner, count = inner_of(x, some)
        words, grams = words[some], grams[some]
    out = np.zeros((len(words) + 1, p["word"].shape[1]), p["word"].dtype)
    if len(words):
        out[:-1] = p["word"][words]
        for k in range(grams.shape[1]):
            out[:-1] += p["gram"][grams[:, k]]
        has = np.flatnonzero(count)
        if len(has):
            first = (np.cumsum(count) - count)[has]
            out[has] += np.add.reduceat(p["gram"][inner], first, axis=0) / count[has][:, None].astype(out.dtype)
    return out


def inner_of(x: Inputs, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inner runs of some words, one after the other, and how many each has."""
    count = x.n_inner[some]
    first = (np.cumsum(x.n_inner) - x.n_inner)[some]
    return x.inner[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())], count


def layer(gates: np.ndarray, ids: np.ndarray, real: np.ndarray | None, back: np.ndarray, keep: bool):
    """One gated recurrent layer over ids by step: states (step, window, unit), and what its gradient needs. real: None if nothing is padding."""
    steps, n, h = *ids.shape, HIDDEN
    state, states, kept = np.zeros((n, h), np.float32), np.empty((steps, n, h), np.float32), []
    for t in range(steps):
        x, r = gates[ids[t]], state @ back
        both = x[:, : 2 * h] + r[:, : 2 * h]
        both *= np.float32(0.5)
        np.tanh(both, out=both)
        both += 1
        both *= np.float32(0.5)
        z, reset = both[:, :h], both[:, h:]
        new = reset * r[:, 2 * h :]
        new += x[:, 2 * h :]
        np.tanh(new, out=new)
        after = states[t]
        np.subtract(state, new, out=after)
        after *= z
        after += new
        if real is not None:
            np.copyto(after, state, where=~real[t][:, None])
        if keep:
            kept.append((state, z, reset, new, r[:, 2 * h :]))
        state = after
    return states, kept


def layer_back(grad: np.ndarray, kept: list, real: np.ndarray, back: np.ndarray):
    """Gradients for the gates' inputs (step, window, gate) and the recurrent weights."""
    steps, n, h = grad.shape
    carry, to_gates, to_back = np.zeros((n, h), np.float32), np.zeros((steps, n, 3 * h), np.float32), np.zeros_like(back)
    for t in range(steps - 1, -1, -1):
        state, z, reset, new, r = kept[t]
        total = grad[t] + carry
        m = real[t][:, None]
        d = total * m
        d_new = d * (1 - z) * (1 - new * new)
        d_z = d * (state - new) * z * (1 - z)
        d_reset = d_new * r * reset * (1 - reset)
        to_gates[t] = np.concatenate([d_z, d_reset, d_new], axis=1)
        through = np.concatenate([d_z, d_reset, d_new * reset], axis=1)
        to_back += state.T @ through
        carry = d * z + through @ back.T + total * ~m
    return to_gates, to_back


def forward(p: dict[str, np.ndarray], rows: np.ndarray, windows: np.ndarray, sizes: np.ndarray, keep: bool = False, gates: np.ndarray | None = None):
    """Logits of windows over embedded words."""
    h = HIDDEN
    if gates is None:
        gates = rows @ p["in"] + p["in_bias"]
    ids, real = np.ascontiguousarray(windows.T), np.arange(WINDOW)[:, None] < sizes
    whole = not keep and bool(real.all())
    ahead, kept_f = layer(gates[:, : 3 * h], ids, None if whole else real, p["back_f"], keep)
    behind, kept_b = layer(gates[:, 3 * h :], ids[::-1], None if whole else real[::-1], p["back_b"], keep)
    states = np.concatenate([ahead, behind[::-1]], axis=2)
    hidden = np.tanh(states @ p["attend"] + p["attend_bias"])
    weight = np.where(real, hidden @ p["focus"], np.float32(-1e9))
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", weight, states)
    return pooled @ p["out"] + p["out_bias"][0], (states, hidden, weight, pooled, real, kept_f, kept_b) if keep else None


def gradients(p: dict[str, np.ndarray], x: Inputs, which: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict[str, tuple | np.ndarray]:
    """Gradients; those of embedding tables as (rows, values)."""
    used, at = np.unique(x.windows[which], return_inverse=True)
    pad = used[-1] == len(x.words)
    some = used[:-1] if pad else used
    words, grams, (inner, count) = x.words[some], x.grams[some], inner_of(x, some)
    rows, windows = embedded(p, x, some), at.reshape(len(which), WINDOW)
    logit, (states, hidden, weight, pooled, real, kept_f, kept_b) = forward(p, rows, windows, x.sizes[which], keep=True)
    h, g = HIDDEN, {}
    d = ((sigmoid(logit) - labels) * weights / len(which)).astype(np.float32)
    g["out"], g["out_bias"] = pooled.T @ d, d.sum(keepdims=True)
    d_pooled = d[:, None] * p["out"]
    d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
    d_states = weight[:, :, None] * d_pooled
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["focus"] = np.einsum("tn,tna->a", d_score, hidden)
    d_hidden = d_score[:, :, None] * p["focus"] * (1 - hidden * hidden)
    g["attend"], g["attend_bias"] = np.einsum("tnh,tna->ha", states, d_hidden), d_hidden.sum(axis=(0, 1))
    d_states = d_states + d_hidden @ p["attend"].T
    gates_f, g["back_f"] = layer_back(d_states[:, :, :h], kept_f, real, p["back_f"])
    gates_b, g["back_b"] = layer_back(d_states[::-1, :, h:], kept_b, real[::-1], p["back_b"])
    d_gates = np.concatenate([gates_f, gates_b[::-1]], axis=2)  # by place in the window
    summed = totals(windows.T.ravel(), d_gates.reshape(-1, 6 * h), len(words) + 1)
    summed[len(words)] = 0
    g["in"], g["in_bias"] = rows.T @ summed, summed.sum(axis=0)
    d_rows = (summed @ p["in"].T)[: len(words)]
    g["word"] = (words, d_rows)
    mean = d_rows / np.maximum(count, 1)[:, None].astype(d_rows.dtype)
    g["gram"] = (np.concatenate([grams.ravel(), inner]), np.concatenate([np.repeat(d_rows, grams.shape[1], axis=0), np.repeat(mean, count, axis=0)]))
    return g


def totals(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by place."""
    order = np.argsort(at, kind="stable")
    places, first = np.unique(at[order], return_index=True)
    out = np.zeros((n, values.shape[1]), np.float32)
    out[places] = np.add.reduceat(values[order], first, axis=0)
    return out


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 11) -> dict[str, np.ndarray] | None:
    """Parameters, or None without both classes."""
    if len(set(labels.tolist())) < 2:
        return None
    p, rng = new_parameters(seed), np.random.default_rng(seed)
    x = Merged(texts)
    every = np.arange(len(x.text))
    share = labels.mean()
    balance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    batch = max(1, min(BATCH, len(texts) // STEPS_AN_EPOCH))
    for epoch in range(EPOCHS_ALL + max(EPOCHS_TOP, min(EPOCHS_FEW, EPOCHS_TOP * ENOUGH // len(texts)))):
        if epoch < EPOCHS_ALL:
            chosen = strongest(x, every, rng.random(len(every)), 3)
        else:
            if (epoch - EPOCHS_ALL) % REFRESH == 0:
                candidates = strongest(x, every, window_logits(p, x, every), CANDIDATES)
            chosen = strongest(x, candidates, window_logits(p, x, candidates), 1)
        chosen = rng.permutation(chosen)
        for k in range(0, len(chosen), batch):
            some = chosen[k : k + batch]
            own = x.text[some]
            g, step = gradients(p, x, some, labels[own].astype(np.float32), balance[own]), step + 1
            for name, d in g.items():
                if isinstance(d, tuple):  # the table's rows that took part
                    rows, back = np.unique(d[0], return_inverse=True)
                    d, at = totals(back, d[1], len(rows)), rows
                else:
                    at = slice(None)
                first[name][at] += 0.1 * (d - first[name][at])
                second[name][at] += 0.001 * (d * d - second[name][at])
                p[name][at] -= (RATE * (first[name][at] / (1 - 0.9**step)) / (np.sqrt(second[name][at] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    logits = text_logits(p, x, len(texts))
    seen = np.isfinite(logits)
    return p | {"scale": calibrated(logits[seen], labels[seen])}


def strongest(x: Inputs, windows: np.ndarray, strength: np.ndarray, n: int) -> np.ndarray:
    """Of the windows, the n strongest of each text."""
    order = windows[np.lexsort((-strength, x.text[windows]))]
    own = x.text[order]
    return order[np.arange(len(order)) - np.searchsorted(own, own) < n]


def calibrated(logit: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Slope and offset of a logistic curve through the training documents, lightly shrunk."""
    a, b = 1.0, 0.0
    for _ in range(200):
        q = sigmoid(a * logit + b)
        w = np.maximum(q * (1 - q), 1e-6)
        grad = np.array([((q - labels) * logit).sum() + 0.1 * (a - 1), (q - labels).sum()])
        hess = np.array([[(w * logit * logit).sum() + 0.1, (w * logit).sum()], [(w * logit).sum(), w.sum() + 1e-6]])
        delta = np.clip(np.linalg.solve(hess, grad), -0.5, 0.5)
        a, b = a - delta[0], b - delta[1]
    return np.array([a, b])


def window_logits(p: dict[str, np.ndarray], x: Inputs, which: np.ndarray) -> np.ndarray:
    """Logits of some windows; full ones first, as they need no masks."""
    gates, out = embedded(p, x) @ p["in"] + p["in_bias"], np.empty(len(which))
    order = np.argsort(-x.sizes[which], kind="stable")
    full = int((x.sizes[which] == WINDOW).sum())
    for k in [*range(0, full, 1024), *range(full, len(which), 1024)]:
        some = order[k : min(k + 1024, full if k < full else len(which))]
        out[some] = forward(p, None, x.windows[which[some]], x.sizes[which[some]], gates=gates)[0]
    return out


def text_logits(p: dict[str, np.ndarray], x: Inputs, n: int) -> np.ndarray:
    """The strongest window's logit of each text; minus infinity without words."""
    out = np.full(n, -np.inf)
    np.maximum.at(out, x.text, window_logits(p, x, np.arange(len(x.text))))
    return out


def scores(p: dict[str, np.ndarray] | None, texts: list[bytes]) -> np.ndarray:
    out = np.zeros(len(texts))
    if p is not None:
        a, b = p["scale"]
        for k, m in slices(texts):
            logit = text_logits(p, Inputs(texts[k:m]), m - k)
            out[k:m] = np.where(np.isfinite(logit), sigmoid(a * np.where(np.isfinite(logit), logit, 0) + b), 0)
    return out


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict[str, np.ndarray] | None:
    """Trained on the bounded sample in one task, so that neither its texts nor the training take the driver's memory."""
    import pyarrow as pa

    def train(batches):
        drawn = sorted(((i, t, label) for b in batches for i, t, label in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[0])
        model = fit([t.encode() for _, t, _ in drawn], np.array([label for *_, label in drawn]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    small_batches(docs)
    row = sample(docs, labels, "toxic", MODULUS, REST, per_class).select("doc_id", "text", "label").repartition(1).mapInArrow(train, "model binary").first()
    return pickle.loads(row.model) if row else None


def scored(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, per_class))
    out = per_text(docs, "score double", lambda texts: [scores(model.value, [t.encode() for t in texts])])
    return out.select("doc_id", held_out(F.col("doc_id"), MODULUS, REST).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_only(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose text is toxic."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))
    return kept_rows(docs, lambda texts: scores(model.value, [t.encode() for t in texts]) < 0.5)
