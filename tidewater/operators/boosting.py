"""Gradient boosting with histogram trees: squared, quantile and logistic loss, and Shapley values of the fitted forest.

A tree grows level by level. For each level tasks sum gradients by node, feature and bin over Arrow batches, and only these sums,
whose number is bounded by 2 ** depth nodes, the features and BINS, come to the driver, which picks the splits. Gradients are whole
numbers of 1 / SCALE, so sums don't depend on the order of rows and a fit repeats exactly. Rows are written in blocks, with their bins once and
with their margin every CUT trees; until then tasks work out the latest trees anew from the bins.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import dropped, written

BINS = 32
SCALE = 1 << 20
CUT = 10
#: Rows of a written block: small enough for readers that take thousands of them at once.
BLOCK = 256


@dataclass
class Tree:
    """Nodes by number, the root 1 and the children of k 2k and 2k + 1: splits (feature, greatest bin on the left), values of leaves, rows."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)
    rows: dict[int, int] = field(default_factory=dict)


@dataclass
class Forest:
    features: list[str]
    edges: list[list[float]]
    loss: str
    quantile: float
    rate: float
    base: float
    trees: list[Tree] = field(default_factory=list)


def bins_of(columns: list[pa.Array], edges: list[list[float]]) -> list[np.ndarray]:
    """The bin of each feature: how many edges lie under the value; 0 for null."""
    out = []
    for c, e in zip(columns, edges, strict=True):
        x = c.cast(pa.float64())
        bins = np.searchsorted(np.asarray(e, float), x.fill_null(0.0).to_numpy(zero_copy_only=False)).astype(np.int8)
        if x.null_count:
            bins[x.is_null().to_numpy(zero_copy_only=False)] = 0
        out.append(bins)
    return out


def edges_of(df: DataFrame, features: list[str]) -> list[list[float]]:
    """Bounds between bins of about equal counts: at most BINS - 1 a feature."""
    shares = [k / BINS for k in range(1, BINS)]
    found = df.agg(*(F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(c) for c in features)).first()
    return [sorted(set(found[c] or [])) for c in features]


def node_of(tree: Tree, bins: list[np.ndarray], node: int = 1) -> np.ndarray:
    """The leaf that each row falls in."""
    if node not in tree.splits:
        return np.full(len(bins[0]), node, np.int32)
    at, most = tree.splits[node]
    return np.where(bins[at] <= most, node_of(tree, bins, 2 * node), node_of(tree, bins, 2 * node + 1))


def value_of(tree: Tree, bins: list[np.ndarray], node: int = 1) -> np.ndarray | float:
    if node not in tree.splits:
        return tree.values.get(node, 0.0)
    at, most = tree.splits[node]
    return np.where(bins[at] <= most, value_of(tree, bins, 2 * node), value_of(tree, bins, 2 * node + 1))


def margin(forest: Forest, trees: list[Tree], start: np.ndarray, bins: list[np.ndarray]) -> np.ndarray:
    for t in trees:
        start = start + forest.rate * value_of(t, bins)
    return start


def slopes(forest: Forest, y: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Negative gradient and curvature of the loss at the margin."""
    if forest.loss == "quantile":
        return np.where(y > m, forest.quantile, forest.quantile - 1), np.ones(len(y))
    if forest.loss == "logistic":
        with np.errstate(over="ignore"):
            p = 1 / (1 + np.exp(-m))
        return y - p, p * (1 - p)
    return y - m, np.ones(len(y))


def whole_sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of whole numbers by place: bincount sums doubles, so large ones are summed in two halves."""
    if len(values) and np.abs(values).max() * len(values) >= 2.0**53:
        high = np.floor(values / 2.0**26)
        return whole_sums(at, high, n) * (1 << 26) + whole_sums(at, values - high * 2.0**26, n)
    return np.bincount(at, values, n).astype(np.int64)


def best_split(hist: np.ndarray, least: int, ridge: float) -> tuple[int, int] | None:
    """hist: features x bins x (gradient, curvature, rows), whole numbers. The split of most gain; of equal ones the first."""
    left = hist.cumsum(axis=1)[:, :-1]
    whole = hist[:, :].sum(axis=1)[:, None]
    right = whole - left
    score = lambda s: (s[..., 0] / SCALE) ** 2 / (s[..., 1] / SCALE + ridge)
    gain = score(left) + score(right) - score(whole)
    gain = np.where((left[..., 2] >= least) & (right[..., 2] >= least), gain, -1.0)
    at = int(gain.argmax())
    f, b = divmod(at, gain.shape[1])
    return (f, b) if gain[f, b] > 1e-9 * max(1.0, float(np.abs(score(whole)).max())) else None


def blocks(bins: list[np.ndarray], y: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    """Rows as blocks of BLOCK: their bins row by row, targets and margins as bytes, so that passes over them cost little outside NumPy."""
    table, n = np.stack(bins, axis=1), len(y)
    cut = lambda x: pa.array([x[k : k + BLOCK].tobytes() for k in range(0, n, BLOCK)], pa.binary())
    return pa.RecordBatch.from_arrays([cut(table), cut(np.asarray(y, float)), cut(np.asarray(m, float))], names=["_bins", "_target", "_margin"])


def read(batches, forest: Forest, fresh: list[Tree]):
    """Bins, targets and margins of written blocks, some of these at a time; fresh are the trees that the written margins lack."""
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            table, y, m = (b"".join(c.to_pylist()) for c in batch.slice(k, 64).columns)
            bins = list(np.ascontiguousarray(np.frombuffer(table, np.int8).reshape(-1, len(forest.features)).T))
            yield bins, np.frombuffer(y), margin(forest, fresh, np.frombuffer(m), bins)


def level_sums(rows: DataFrame, forest: Forest, fresh: list[Tree], tree: Tree, nodes: list[int]) -> dict[int, np.ndarray]:
    """Of each node: features x bins x (gradient, curvature, rows). Each task sums its own rows, so what is shuffled follows the nodes."""
    n_features = len(forest.features)

    def run(batches):
        slot = np.full(2 * max(nodes) + 2, -1)
        slot[nodes] = np.arange(len(nodes))
        sums = np.zeros((n_features, 3, len(nodes) * BINS), np.int64)
        for bins, y, m in read(batches, forest, fresh):
            own = slot[node_of(tree, bins)]
            g, h = (np.rint(x * SCALE) for x in slopes(forest, y, m))
            if (own < 0).any():
                some = np.flatnonzero(own >= 0)
                own, g, h, bins = own[some], g[some], h[some], [x[some] for x in bins]
            for f in range(n_features):
                at = own * BINS + bins[f]
                sums[f] += (whole_sums(at, g, sums.shape[2]), whole_sums(at, h, sums.shape[2]), np.bincount(at, minlength=sums.shape[2]))
        f, at = np.nonzero(sums[:, 2])
        columns = [np.array(nodes)[at // BINS], f, at % BINS, *(sums[f, k, at] for k in range(3))]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["_node", "_f", "_b", "g", "h", "n"])

    parts = rows.mapInArrow(run, "_node long, _f long, _b long, g long, h long, n long")
    hist = {k: np.zeros((n_features, BINS, 3), np.int64) for k in nodes}
    for r in parts.groupBy("_node", "_f", "_b").agg(*(F.sum(c).alias(c) for c in "ghn")).collect():
        hist[r["_node"]][r["_f"], r["_b"]] = (r.g, r.h, r.n)
    return hist


def grow(rows: DataFrame, forest: Forest, fresh: list[Tree], depth: int, least: int, ridge: float) -> Tree:
    """One tree on the rows' present gradients: an aggregation a level but the last, whose sums are parts of those above; quantiles of the leaves after it."""
    tree, open_ = Tree(), [1]

    def note(node: int, sums: np.ndarray) -> None:
        tree.rows[node] = int(sums[2])
        tree.values[node] = float(sums[0] / SCALE / (sums[1] / SCALE + ridge)) if sums[2] else 0.0

    for level in range(max(depth, 1)):
        hist, following = level_sums(rows, forest, fresh, tree, open_), []
        for k in open_:
            note(k, hist[k][0].sum(axis=0))
            split = best_split(hist[k], least, ridge) if level < depth else None
            if split:
                tree.splits[k] = split
                f, most = split
                note(2 * k, hist[k][f, : most + 1].sum(axis=0))
                note(2 * k + 1, hist[k][f, most + 1 :].sum(axis=0))
                following += [2 * k, 2 * k + 1]
        open_ = following
        if not open_:
            break
    if forest.loss == "quantile":

        def rest(batches):
            for bins, y, m in read(batches, forest, fresh):
                yield pa.RecordBatch.from_arrays([pa.array(node_of(tree, bins)), pa.array(y - m)], names=["node", "rest"])

        tree.values.update(quantiles(rows.mapInArrow(rest, "node int, rest double"), "node", "rest", forest.quantile))
    return tree


def quantiles(df: DataFrame, group: str, value: str, q: float, accuracy: int = 10_000) -> dict:
    """The exact quantile of each group, linear between two values, as percentile gives it; groups are few.

    A sketch brackets it, then the values in the bracket are counted, whose number follows the rows over the accuracy: no task holds a group.
    """
    rows = df.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    wide, out = 2 / accuracy, {}
    sizes = None
    while sizes is None or out.keys() < sizes:
        ends = [max(0.0, q - wide), min(1.0, q + wide)]
        found = rows.groupBy("_g").agg(F.percentile_approx("_v", ends, accuracy).alias("p")).collect()
        sizes = {r["_g"] for r in found}
        if not found:
            break
        low = F.broadcast(df.sparkSession.createDataFrame([(r["_g"], None if wide >= 1 or ends[0] == 0 else r.p[0], None if wide >= 1 or ends[1] == 1 else r.p[1]) for r in found], rows.select("_g", F.col("_v").alias("_low"), F.col("_v").alias("_high")).schema))
        side = F.when(F.col("_v") < F.col("_low"), -1).when(F.col("_v") > F.col("_high"), 1).otherwise(0)
        counts = rows.join(low, "_g").select("_g", side.alias("_side"), F.when(side == 0, F.col("_v")).alias("_v")).groupBy("_g", "_side", "_v").agg(F.count(F.lit(1)).alias("_n"))
        w = Window.partitionBy("_g")
        upto = F.sum("_n").over(w.orderBy("_side", "_v").rowsBetween(Window.unboundedPreceding, 0))
        place = (F.sum("_n").over(w) - 1) * F.lit(q)
        near = counts.select("_g", "_side", "_v", "_n", upto.alias("_upto"), place.alias("_at"))
        holds = lambda k: (k >= F.col("_upto") - F.col("_n")) & (k < F.col("_upto"))
        near = near.select("_g", "_v", "_at", holds(F.floor("_at")).alias("_l"), holds(F.ceil("_at")).alias("_h")).where("_side = 0 AND (_l OR _h)").collect()
        lower, upper = {r["_g"]: r for r in near if r["_l"]}, {r["_g"]: r["_v"] for r in near if r["_h"]}
        for g in lower.keys() & upper.keys():
            a, b, at = lower[g]["_v"], upper[g], lower[g]["_at"]
            out[g] = a if a == b else (math.ceil(at) - at) * a + (at - math.floor(at)) * b
        wide *= 8
    return out


def fit(df: DataFrame, features: list[str], y: str, loss: str = "squared", quantile: float = 0.5, trees: int = 20, depth: int = 3, rate: float = 0.2, least: int = 20, ridge: float = 1.0) -> Forest:
    """A forest for y. loss: squared, quantile (then of that quantile) or logistic (y is 0 or 1, the margin its log odds). Rows with a null y take no part."""
    known = df.where(F.col(y).isNotNull()).select(*(F.col(c).cast("double").alias(c) for c in features), F.col(y).cast("double").alias("_target"))
    known = written(known, "boost")  # read several times, so df is computed once
    forest = Forest(features, edges_of(known, features), loss, quantile, rate, 0.0)
    if loss == "quantile":
        start = quantiles(known.withColumn("_all", F.lit(1)), "_all", "_target", quantile).get(1, 0.0)
    else:
        start = known.agg(F.avg("_target").alias("v")).first().v or 0.0
    if loss == "logistic":
        start = min(max(start, 1e-6), 1 - 1e-6)
        start = math.log(start / (1 - start))
    forest.base = float(start)
    schema = "_bins binary, _target binary, _margin binary"

    def first(batches):
        for b in batches:
            yield blocks(bins_of(b.columns[:-1], forest.edges), b.column(len(features)).to_numpy(zero_copy_only=False), np.full(b.num_rows, forest.base))

    def further(fresh):
        def run(batches):
            for rows in read(batches, forest, fresh):
                yield blocks(*rows)

        return run

    rows = written(known.mapInArrow(first, schema), "boost")
    dropped(known)
    fresh: list[Tree] = []
    for k in range(trees):
        if len(fresh) == CUT:
            after = written(rows.mapInArrow(further(fresh), schema), "boost")
            dropped(rows)
            rows, fresh = after, []
        fresh = [*fresh, grow(rows, forest, fresh, depth, least, ridge)]
        forest.trees.append(fresh[-1])
    dropped(rows)
    return forest


def value_column(forest: Forest):
    """A function that gives, of columns of the features, the forest's value: the mean, the quantile, or the probability."""

    def run(*columns: pa.Array) -> pa.Array:
        bins = bins_of(list(columns), forest.edges)
        return pa.array(margin(forest, forest.trees, np.full(len(bins[0]), forest.base), bins))

    m = F.arrow_udf(run, "double")
    return (lambda *c: 1 / (1 + F.exp(-m(*c)))) if forest.loss == "logistic" else m


def predicted(df: DataFrame, forest: Forest, name: str = "prediction") -> DataFrame:
    """df with the forest's value: the mean, the quantile, or the probability."""
    return df.withColumn(name, value_column(forest)(*(F.col(c).cast("double") for c in forest.features)))


def expected(tree: Tree, bins: np.ndarray, known: frozenset[int], node: int = 1) -> np.ndarray:
    """The tree's value for rows of bins when only some features are known: branches of others are weighed by their rows."""
    if node not in tree.splits:
        return np.full(len(bins), tree.values.get(node, 0.0))
    f, most = tree.splits[node]
    left, right = expected(tree, bins, known, 2 * node), expected(tree, bins, known, 2 * node + 1)
    if f in known:
        return np.where(bins[:, f] <= most, left, right)
    n, m = tree.rows[2 * node], tree.rows[2 * node + 1]
    return (n * left + m * right) / max(1, n + m)


def shapley(forest: Forest, bins: np.ndarray) -> np.ndarray:
    """Shapley values (rows x features) of the margin: with the forest's expectation they sum to it. A tree of few features needs few subsets."""
    out = np.zeros((len(bins), len(forest.features)))
    for t in forest.trees:
        own = sorted({f for f, _ in t.splits.values()})
        worth = {frozenset(s): expected(t, bins, frozenset(s)) for n in range(len(own) + 1) for s in itertools.combinations(own, n)}
        for f in own:
            for s in worth:
                if f not in s:
                    weight = math.factorial(len(s)) * math.factorial(len(own) - len(s) - 1) / math.factorial(len(own))
                    out[:, f] += forest.rate * weight * (worth[s | {f}] - worth[s])
    return out


def expectation(forest: Forest) -> float:
    """The margin when no feature is known."""
    none = np.zeros((1, len(forest.features)), np.int64)
    return forest.base + sum(forest.rate * float(expected(t, none, frozenset())[0]) for t in forest.trees)


#: Tables of Shapley values by a tree's cells have at most so many.
CELLS = 4096


def shapley_tables(forest: Forest) -> list[Forest | tuple]:
    """Of each tree its features, their thresholds and the Shapley values of the cells between these, or the tree alone where cells are too many."""
    out = []
    for t in forest.trees:
        alone = Forest(forest.features, forest.edges, forest.loss, forest.quantile, forest.rate, 0.0, [t])
        own = sorted({f for f, _ in t.splits.values()})
        if not own:
            continue  # one leaf: all features have 0
        at = [sorted({b for f, b in t.splits.values() if f == g}) for g in own]
        shape = [len(x) + 1 for x in at]
        if math.prod(shape) > CELLS:
            out.append(alone)
            continue
        cells = np.zeros((math.prod(shape), len(forest.features)), np.int64)
        for g, x, k in zip(own, at, np.indices(shape).reshape(len(shape), -1), strict=True):
            cells[:, g] = np.array([*x, x[-1] + 1])[k]
        out.append((own, at, shape, shapley(alone, cells)))
    return out


def looked_up(tables: list, bins: list[np.ndarray]) -> np.ndarray:
    """As shapley, from its tables."""
    out = 0.0
    for t in tables:
        if isinstance(t, Forest):
            out = out + shapley(t, np.stack(bins, axis=1))
        else:
            own, at, shape, values = t
            cell = np.zeros(len(bins[0]), np.int64)
            for g, x, n in zip(own, at, shape, strict=True):
                cell = cell * n + np.searchsorted(x, bins[g])
            out = out + values[cell]
    return out if len(tables) else np.zeros((len(bins[0]), len(bins)))


def shap_values(df: DataFrame, forest: Forest, keep: list[str]) -> DataFrame:
    """keep and, as doubles, shap_<feature> of every row, and margin, their sum with the expectation."""
    rows = df.select(*keep, *(F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(forest.features)))
    names = [f"shap_{c}" for c in forest.features]
    base, tables = expectation(forest), shapley_tables(forest)

    def run(batches):
        for b in batches:
            values = looked_up(tables, bins_of(b.columns[len(keep) :], forest.edges))
            columns = [pa.array(values[:, k]) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), *columns, pa.array(base + values.sum(axis=1))], names=[*keep, *names, "margin"])

    schema = rows.select(*keep, *(F.lit(0.0).alias(n) for n in [*names, "margin"])).schema
    return rows.mapInArrow(run, schema)


def family_shares(values: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """family and share of the mean absolute Shapley value that its features have together."""
    means = {k: reduce_sum([F.avg(F.abs(f"shap_{c}")) for c in cs]) for k, cs in families.items()}
    row = values.agg(*(m.alias(k) for k, m in means.items()))
    stacked = row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("family"), F.col(k).alias("v")) for k in families))).alias("x")).select("x.*")
    total = row.select(reduce_sum([F.col(k) for k in families]).alias("total"))
    return stacked.crossJoin(F.broadcast(total)).select("family", (F.col("v") / F.nullif("total", F.lit(0.0))).alias("share"))


def reduce_sum(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def moved(df: DataFrame, features: list[str], key: str, deals: int = 64) -> DataFrame:
    """df with _moved_<feature>: the features' values moved on by one row in the order of a hash of the key, within deals of rows by the same hash."""
    deal = F.pmod(F.xxhash64(key), F.lit(deals))
    w = Window.partitionBy(deal).orderBy(F.xxhash64(F.lit(7), key), key)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.lead(F.lit(1)).over(w).isNull()
    return df.select("*", *(F.when(last, F.first(c).over(whole)).otherwise(F.lead(c).over(w)).alias(f"_moved_{c}") for c in features))


def permuted(df: DataFrame, feature: str, key: str, deals: int = 64) -> DataFrame:
    """df with the feature's values moved."""
    return moved(df, [feature], key, deals).withColumn(feature, F.col(f"_moved_{feature}")).drop(f"_moved_{feature}")


def permutation_importance(df: DataFrame, forest: Forest, y: str, key: str) -> DataFrame:
    """feature and gain: by how much the mean squared error grows when the feature's values are permuted among rows.

    All features are moved in one order of the rows, so these are dealt and sorted once.
    """
    value = value_column(forest)
    error = lambda c: F.avg((F.col(y) - value(*(F.col(f"_moved_{f}" if f == c else f).cast("double") for f in forest.features))) ** 2)
    rows = moved(df.select(key, y, *forest.features), forest.features, key)
    row = rows.agg(error(None).alias("_base"), *(error(c).alias(c) for c in forest.features))
    return row.select("_base", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("e")) for c in forest.features))).alias("x")).select("x.feature", (F.col("x.e") - F.col("_base")).alias("gain"))
