"""Classification of sequences by a small convolutional network, trained on all rows in Spark.

Each epoch is one pass: a task sums its rows' gradients, Spark adds the tasks' sums by place, and only sums of the network's size come
to the driver, which takes the step. Sums are whole numbers of 1 / SCALE, so they don't depend on the order of rows or tasks.

The network: two convolutions of KERNEL over time, the second dilated, each with a rectifier; the mean and the maximum over time; a
linear unit for each class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dropped, written

KERNEL, CHANNELS, DILATION = 5, 8, 2
SCALE = 1 << 24
ROWS = 512

Parameters = dict[str, np.ndarray]


def new_parameters(inputs: int, classes: int, seed: int = 3) -> Parameters:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.standard_normal(shape) * np.sqrt(2 / np.prod(shape[:-1]))
    return {"one": draw(KERNEL, inputs, CHANNELS), "one_bias": np.zeros(CHANNELS), "two": draw(KERNEL, CHANNELS, CHANNELS), "two_bias": np.zeros(CHANNELS), "out": draw(2 * CHANNELS, classes), "out_bias": np.zeros(classes)}


def taps(x: np.ndarray, dilation: int) -> np.ndarray:
    """x (rows, steps, channels) at KERNEL places around each step: (rows, steps, KERNEL, channels), zeros beyond the ends."""
    reach = KERNEL // 2 * dilation
    wide = np.pad(x, ((0, 0), (reach, reach), (0, 0)))
    return np.stack([wide[:, k * dilation : k * dilation + x.shape[1]] for k in range(KERNEL)], axis=2)


def spread(grad: np.ndarray, dilation: int) -> np.ndarray:
    """The gradient of x from that of its taps."""
    reach = KERNEL // 2 * dilation
    n, steps, _, channels = grad.shape
    wide = np.zeros((n, steps + 2 * reach, channels))
    for k in range(KERNEL):
        wide[:, k * dilation : k * dilation + steps] += grad[:, :, k]
    return wide[:, reach : reach + steps]


def forward(p: Parameters, x: np.ndarray):
    """Probabilities of the classes, and what the gradient needs."""
    t1 = taps(x, 1)
    h1 = np.maximum(np.einsum("ntkc,kcd->ntd", t1, p["one"]) + p["one_bias"], 0)
    t2 = taps(h1, DILATION)
    h2 = np.maximum(np.einsum("ntkc,kcd->ntd", t2, p["two"]) + p["two_bias"], 0)
    pooled = np.concatenate([h2.mean(axis=1), h2.max(axis=1)], axis=1)
    logit = pooled @ p["out"] + p["out_bias"]
    e = np.exp(logit - logit.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True), (t1, h1, t2, h2, pooled)


def gradients(p: Parameters, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[Parameters, float]:
    """Sums over rows of the gradients of the weighted cross entropy, and of the loss itself."""
    q, (t1, h1, t2, h2, pooled) = forward(p, x)
    n, steps = h2.shape[:2]
    loss = float(-(weight * np.log(np.maximum(q[np.arange(n), y], 1e-300))).sum())
    d = q.copy()
    d[np.arange(n), y] -= 1
    d *= weight[:, None]
    g = {"out": pooled.T @ d, "out_bias": d.sum(axis=0)}
    d_pooled = d @ p["out"].T
    d2 = np.repeat(d_pooled[:, None, :CHANNELS] / steps, steps, axis=1)
    top = h2.argmax(axis=1)
    np.add.at(d2, (np.arange(n)[:, None], top, np.arange(CHANNELS)), d_pooled[:, CHANNELS:])
    d2 *= h2 > 0
    g["two"], g["two_bias"] = np.einsum("ntkc,ntd->kcd", t2, d2), d2.sum(axis=(0, 1))
    d1 = spread(np.einsum("ntd,kcd->ntkc", d2, p["two"]), DILATION) * (h1 > 0)
    g["one"], g["one_bias"] = np.einsum("ntkc,ntd->kcd", t1, d1), d1.sum(axis=(0, 1))
    return g, loss


def arrays_of(column: pa.Array, steps: int) -> np.ndarray:
    """Lists of numbers as rows of steps, cut or continued by zeros; nulls are zeros."""
    out = np.zeros((len(column), steps, 1))
    for k, own in enumerate(column.to_pylist()):
        some = [v or 0.0 for v in (own or [])[:steps]]
        out[k, : len(some), 0] = some
    return out


def fit(df: DataFrame, series: str, label: str, steps: int, classes: int, epochs: int = 30, rate: float = 0.05, seed: int = 3) -> tuple[Parameters, list[float]]:
    """Parameters and the mean loss of each epoch. Classes count alike, whatever their number of rows; rows without a label, or with one that is no class, take no part."""
    rows = df.where(F.col(label).between(0, classes - 1)).select(F.col(series).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"))
    rows = written(rows, "series")
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    p, losses = new_parameters(1, classes, seed), []
    if not counts:
        dropped(rows)
        return p, losses
    weight = np.array([sum(counts.values()) / (len(counts) * counts[k]) if k in counts else 0.0 for k in range(classes)])
    names, total = list(p), sum(counts.values())
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for epoch in range(epochs):
        now = {k: v.copy() for k, v in p.items()}

        def run(batches, now=now):
            whole = None
            for b in batches:
                for k in range(0, b.num_rows, ROWS):
                    part = b.slice(k, ROWS)
                    y = part.column(1).to_numpy()
                    sums, loss = gradients(now, arrays_of(part.column(0), steps), y, weight[y])
                    flat = np.rint(np.concatenate([*(sums[name].ravel() for name in names), [loss]]) * SCALE).astype(np.int64)
                    whole = flat if whole is None else whole + flat
            if whole is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(whole), dtype=np.int32)), pa.array(whole)], names=["place", "v"])

        found = np.zeros(sum(v.size for v in p.values()) + 1)
        for r in rows.mapInArrow(run, "place int, v long").groupBy("place").agg(F.sum("v").alias("v")).collect():
            found[r.place] = r.v / SCALE / total
        losses.append(float(found[-1]))
        at = 0
        for k in names:
            d = found[at : at + p[k].size].reshape(p[k].shape)
            at += p[k].size
            first[k] += 0.1 * (d - first[k])
            second[k] += 0.01 * (d * d - second[k])
            p[k] = p[k] - rate * (first[k] / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(second[k] / (1 - 0.99 ** (epoch + 1))) + 1e-8)
    dropped(rows)
    return p, losses


def classified(df: DataFrame, p: Parameters, series: str, steps: int, keep: list[str]) -> DataFrame:
    """keep, the likeliest class of each row (of equal ones the least) and its probability."""
    rows = df.select(*keep, F.col(series).cast("array<double>").alias("_x"))
    schema = rows.select(*keep, F.lit(0).alias("predicted"), F.lit(0.0).alias("probability")).schema

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                q, _ = forward(p, arrays_of(part.column(len(keep)), steps))
                yield pa.RecordBatch.from_arrays([*(part.column(j) for j in range(len(keep))), pa.array(q.argmax(axis=1).astype(np.int32)), pa.array(q.max(axis=1))], names=[*keep, "predicted", "probability"])

    return rows.mapInArrow(run, schema)
