"""Joins that Spark's own join operators don't name: as-of, densifying, neighbours on grids, distances, fuzzy matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row at or before it, per key; null before the first.

    One shuffle by key: both sides are unioned and the last values carried on in a window. Of right rows at one
    time the greatest values count.
    """
    mark = F.struct(*(F.col(v) for v in values))
    a = left.select(*by, F.col(left_on).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(mark.alias("m")).schema["m"].dataType).alias("_mark"))
    b = right.select(*by, F.col(right_on).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), mark.alias("_mark"))
    order = Window.partitionBy(*by).orderBy("_at", "_side", "_mark").rowsBetween(Window.unboundedPreceding, 0)
    seen = a.unionByName(b).withColumn("_last", F.last("_mark", ignorenulls=True).over(order)).where("_side = 1")
    return seen.select("_row.*", *(F.col("_last")[v].alias(v) for v in values))


def densify(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """All days from df's first to its last for every key, with df's columns where there are rows."""
    days = F.broadcast(df.agg(F.explode(F.sequence(F.min(day), F.max(day))).alias(day)))  # a row a day
    spine = df.select(*keys).distinct().crossJoin(days)
    return spine.join(df, [*keys, day], "left")


def cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def neighbours(df: DataFrame, x: str, y: str, reach: int = 1) -> DataFrame:
    """Every row once for each cell of the square of cells around its own; the offsets are a literal, so nothing is joined."""
    steps = F.array(*(F.lit(k) for k in range(-reach, reach + 1)))
    return df.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps)).withColumn(x, F.col(x) + F.col("_dx")).withColumn(y, F.col(y) + F.col("_dy")).drop("_dx", "_dy")


def within_distance(a: DataFrame, b: DataFrame, ax: str, ay: str, bx: str, by: str, radius: float) -> DataFrame:
    """Pairs within the radius in the plane, by an equi-join on grid cells of that size and its neighbours."""
    left = a.withColumn("_cx", cell(F.col(ax), radius)).withColumn("_cy", cell(F.col(ay), radius))
    right = neighbours(b.withColumn("_cx", cell(F.col(bx), radius)).withColumn("_cy", cell(F.col(by), radius)), "_cx", "_cy")
    d = F.hypot(F.col(ax) - F.col(bx), F.col(ay) - F.col(by))
    return left.join(right, ["_cx", "_cy"]).withColumn("distance", d).where(F.col("distance") <= radius).drop("_cx", "_cy")


def sums_within(a: DataFrame, b: DataFrame, key: str, ax: str, ay: str, bx: str, by: str, radius: float) -> DataFrame:
    """key of a, and n and total: how many of b's points are within the radius, and the sum of their bx. No pair is made.

    Both sides meet in grid cells, a's points in their own and the neighbouring ones. b's points of one place are counted first; in a
    cell those of one by are sorted by bx, where a circle holds a stretch, so its ends are sought and sums are differences of running
    ones. The ends are settled by sqrt(dx * dx + dy * dy) <= radius itself. Keys of a are distinct; points with a null take no part.
    """
    import numpy as np
    import pyarrow as pa

    left = neighbours(a.select(F.col(key).alias("_k"), F.col(ax).cast("double").alias("_x"), F.col(ay).cast("double").alias("_y")).dropna(subset=["_x", "_y"]).withColumn("_cx", cell(F.col("_x"), radius)).withColumn("_cy", cell(F.col("_y"), radius)), "_cx", "_cy")
    right = b.select(F.col(bx).cast("double").alias("_x"), F.col(by).cast("double").alias("_y")).dropna().groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_n"))
    right = right.withColumn("_cx", cell(F.col("_x"), radius)).withColumn("_cy", cell(F.col("_y"), radius))

    def run(own: pa.Table, other: pa.Table) -> pa.Table:
        column = lambda t, c: t.column(c).to_numpy()
        order = np.argsort(column(own, "_x"), kind="stable") if own.num_rows else np.zeros(0, int)
        keys, n, total = own.column("_k").take(pa.array(order)), np.zeros(len(order), np.int64), np.zeros(len(order))
        if len(order) and other.num_rows:
            x, y = column(own, "_x")[order], column(own, "_y")[order]
            px, py, pn = (column(other, c) for c in ("_x", "_y", "_n"))
            sort = np.lexsort((px, py))
            px, py, pn = px[sort], py[sort], pn[sort]
            rows = np.flatnonzero(np.append(True, py[1:] != py[:-1]))
            for lo, hi in zip(rows, np.append(rows[1:], len(py))):
                xs, upto, sums = px[lo:hi], np.append(0, np.cumsum(pn[lo:hi])), np.append(0.0, np.cumsum(px[lo:hi] * pn[lo:hi]))
                dy = py[lo] - y
                near = np.flatnonzero(np.abs(dy) <= radius)
                at, dy2, last = x[near], dy[near] * dy[near], len(xs) - 1
                reach = np.sqrt(np.maximum(radius * radius - dy2, 0.0))
                inside = lambda k: np.sqrt((xs[np.clip(k, 0, last)] - at) * (xs[np.clip(k, 0, last)] - at) + dy2) <= radius  # noqa: B023, E731
                first, end = np.searchsorted(xs, at - reach, "left"), np.searchsorted(xs, at + reach, "right")
                while (wider := (first > 0) & inside(first - 1)).any():
                    first = first - wider
                while (less := (first < end) & ~inside(first)).any():
                    first = first + less
                end = np.maximum(end, first)
                while (wider := (end <= last) & inside(end)).any():
                    end = end + wider
                while (less := (end > first) & ~inside(end - 1)).any():
                    end = end - less
                n[near] += upto[end] - upto[first]
                total[near] += sums[end] - sums[first]
        some = np.flatnonzero(n)
        return pa.table({"_k": keys.take(pa.array(some)), "n": n[some], "total": total[some]})

    kind, n_parts = dict(left.dtypes)["_k"], int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (t.repartition(n_parts, "_cx", "_cy") for t in (left, right))  # cells are small in bytes, so they would be put in few tasks
    parts = left.groupBy("_cx", "_cy").cogroup(right.groupBy("_cx", "_cy")).applyInArrow(run, f"_k {kind}, n long, total double")
    return parts.groupBy(F.col("_k").alias(key)).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


#: Ranges of values that a group's rows are sorted in; a group of very many rows is as many tasks.
RANGES = 64


def nearest_value(left: DataFrame, right: DataFrame, by: str, at: str, key: str) -> DataFrame:
    """Each left row with the key of the right row of its group whose value is nearest, and the gap; of equal gaps the lesser key.

    right has one row a value. Both sides are sorted by value within ranges of about equal counts: the nearest is the last one before
    or the first one after, in the row's own range or else in the next one that has any, of which each group has a list of RANGES at most.
    """
    mark = right.select(F.struct(F.col(at), F.col(key)).alias("m")).schema["m"].dataType
    both = left.withColumn("_m", F.lit(None).cast(mark)).unionByName(right.select(by, at, F.struct(F.col(at), F.col(key)).alias("_m")), allowMissingColumns=True)
    edges = right.select(F.percentile_approx(F.col(at).cast("double"), [k / RANGES for k in range(1, RANGES)], 1000)).first()[0] or []
    ranged = both.withColumn("_r", F.size(F.filter(F.array(*map(F.lit, sorted(set(edges)))), lambda e: e < F.col(at))) if edges else F.lit(0))
    ends = ranged.where("_m IS NOT NULL").groupBy(by, "_r").agg(F.min("_m").alias("first"), F.max("_m").alias("last"))
    of_group = ends.groupBy(F.col(by).alias("_by")).agg(F.collect_list(F.struct("_r", "first", "last")).alias("_ends"))
    order = Window.partitionBy(by, "_r").orderBy(at)
    near = lambda m: F.when(m.isNotNull(), F.struct(F.abs(F.col(at) - m[at]).alias("gap"), m[key].alias(key)))
    own_before = F.last("_m", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    own_after = F.first("_m", ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing))
    found = ranged.withColumn("_before", own_before).withColumn("_after", own_after).where("_m IS NULL").join(of_group, F.col(by).eqNullSafe(F.col("_by")), "left")
    before = F.coalesce("_before", F.array_max(F.filter("_ends", lambda e: e["_r"] < F.col("_r")))["last"])
    after = F.coalesce("_after", F.array_min(F.filter("_ends", lambda e: e["_r"] > F.col("_r")))["first"])
    found = found.withColumn("_before", near(before)).withColumn("_after", near(after))
    best = F.when(F.col("_before").isNull() | F.col("_after").isNull(), F.coalesce("_before", "_after")).otherwise(F.least("_before", "_after"))
    return found.withColumn("_best", best).where("_best IS NOT NULL").select(*left.columns, f"_best.{key}", "_best.gap")


def overlap_days(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Days that two closed date intervals share."""
    return F.greatest(F.lit(0), F.datediff(F.least(a_to, b_to), F.greatest(a_from, b_from)) + 1)


def best_match(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Each left string's most similar right string by edit ratio, 1 - edits / longer length, if that is 0.8 or more; ties go to the lesser string.

    Such strings are at most k = length / 4 edits apart, so of k + 1 pieces of the left one some stands unchanged in the right
    one, at most k places away. Pieces have one to four letters and meet as an equi-join; only these pairs are compared.
    """
    n, k = F.length(left), F.floor(F.length(left) / 4)
    edge = lambda i: F.floor(i * n / (k + 1))
    pieces = F.transform(F.sequence(F.lit(0).cast("long"), k), lambda i: F.struct(edge(i).alias("at"), F.substr(left, (edge(i) + 1).cast("int"), (edge(i + 1) - edge(i)).cast("int")).alias("piece")))
    own = a.select(left).distinct().select(left, k.alias("_k"), F.inline(pieces).alias("_at", "_piece"))
    m = F.length(right)
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(4), m)), lambda w: F.transform(F.sequence(F.lit(0), m - w), lambda i: F.struct(i.alias("to"), F.substr(right, i + 1, w).alias("piece")))))
    other = b.select(right).distinct().where(m > 0).select(right, F.inline(grams).alias("_to", "_piece"))
    pairs = own.join(other, "_piece").where(F.abs(F.col("_at") - F.col("_to")) <= F.col("_k")).select(left, right).distinct()
    ratio = 1 - F.levenshtein(left, right) / F.greatest(n, m)
    best = pairs.withColumn("ratio", ratio).where("ratio >= 0.8").groupBy(left).agg(F.min(F.struct((-F.col("ratio")).alias("less"), right)).alias("best"))
    return best.select(left, f"best.{right}", (-F.col("best.less")).alias("ratio"))


def in_polygons(points: DataFrame, polygons: DataFrame, x: str, y: str, ring: str, size: float) -> DataFrame:
    """Points with each polygon that holds them. A ring is an array of structs x and y, without its first corner again.

    Both sides meet in the grid cells of the given size that a polygon's box covers, as an equi-join; then a ray to the right
    must cross the ring an odd number of times.
    """
    low = lambda k: cell(F.array_min(F.transform(ring, lambda p: p[k])), size)
    high = lambda k: cell(F.array_max(F.transform(ring, lambda p: p[k])), size)
    covered = polygons.withColumn("_cx", F.explode(F.sequence(low("x"), high("x")))).withColumn("_cy", F.explode(F.sequence(low("y"), high("y"))))
    met = points.withColumn("_cx", cell(F.col(x), size)).withColumn("_cy", cell(F.col(y), size)).join(covered, ["_cx", "_cy"])
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))

    def crossed(side):
        a, b = side["a"], side["b"]
        between = (F.least(a["y"], b["y"]) <= F.col(y)) & (F.col(y) < F.greatest(a["y"], b["y"]))
        return between & (F.col(x) < a["x"] + (F.col(y) - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)))

    sides = F.zip_with(ring, following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return met.where(F.size(F.filter(sides, crossed)) % 2 == 1).drop("_cx", "_cy", ring)
