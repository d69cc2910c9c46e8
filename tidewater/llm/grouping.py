"""Classes of linked nodes by union-find, in tasks and over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import dropped, written

#: Links that a task joins by union-find at a time: 16 bytes each, and some objects while it does.
LINKS = 500_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over the links (a, b): every node that is not its own root, with its root."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    to = np.array([root(x) for x in range(len(names))], np.int64)
    own = np.flatnonzero(to != np.arange(len(names)))
    return names[own], names[to[own]] if len(own) else names[own]


def united(links: DataFrame, a: str, b: str) -> DataFrame:
    """node and label, the least node of its class, of the nodes that stand in a link between different nodes.

    Each task joins its own links and passes one link on for each node, to its root. If no more than LINKS are left, as they are counted,
    one task joins them; else alternating stars do, over all tasks.
    """

    def run(batches):
        held, n = [], 0

        def joined_links() -> pa.RecordBatch:
            x, y = (np.concatenate([np.asarray(h[k]) for h in held]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in roots(x, y)], names=["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n > LINKS:
                yield joined_links()
                held, n = [], 0
        if n:
            yield joined_links()

    own = links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    left = written(own.mapInArrow(run, "a long, b long"), "links")
    if left.count() > LINKS:
        out = components(left, "a", "b")
    else:
        joined = written(left.coalesce(1).mapInArrow(run, "a long, b long"), "links")
        out = joined.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(joined.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
    dropped(left)
    return out
