"""Window operators over ordered rows: rolling with least counts, runs, interpolation, crossings, suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def rolling(agg, x: str, order: WindowSpec, first: int, last: int, min_periods: int = 1) -> Column:
    """agg(x) over rows first to last around the current one, null under min_periods values."""
    frame = order.rowsBetween(first, last)
    return F.when(F.count(x).over(frame) >= min_periods, agg(x).over(frame))


def run_lengths(df: DataFrame, by: list[str], order: str, flag: Column) -> DataFrame:
    """run: rows since flag last held, 0 where it holds; runs before the first holding row count from its start."""
    w = Window.partitionBy(*by).orderBy(order)
    marked = df.withColumn("_g", F.sum(flag.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = Window.partitionBy(*by, "_g").orderBy(order)
    return marked.withColumn("run", F.row_number().over(first) - F.when(F.col("_g") > 0, 1).otherwise(0)).drop("_g")


def islands(df: DataFrame, by: list[str], order: str, gap: float) -> DataFrame:
    """island: rows of a key whose order values follow within gap of each other share a number from 1 on."""
    w = Window.partitionBy(*by).orderBy(order)
    starts = F.when(F.col(order) - F.lag(order).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("_s", starts).withColumn("island", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def interpolated(x: str, at: str, order: WindowSpec) -> Column:
    """x where known, else linear between the known rows around it; null beyond the ends."""
    known = F.when(F.col(x).isNotNull(), F.struct(at, x))
    before = F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    along = (F.col(at) - before[at]) / (after[at] - before[at])
    return F.coalesce(F.col(x), before[x] + (after[x] - before[x]) * along)


def crossings(below: Column, order: WindowSpec) -> Column:
    """True on the rows where below begins to hold."""
    return below & ~F.coalesce(F.lag(below).over(order), F.lit(False))


def sliced_bins(order: WindowSpec, whole: WindowSpec, bins: int) -> Column:
    """Equal-count bins of floor(n / bins) rows in order; the remainder is null."""
    size = F.floor(F.count(F.lit(1)).over(whole) / bins)
    b = F.floor((F.row_number().over(order) - 1) / F.nullif(size, F.lit(0)))
    return F.when(b < bins, b)


def spaced(df: DataFrame, by: list[str], at: str, apart: int) -> DataFrame:
    """Greedy picking in order: a row stays if it is at least `apart` after the last that stayed. Null values never stay.

    After a gap of `apart` the next row stays whatever came before, so such stretches are independent and are dealt to tasks as
    groups of their own, not by key. A task reads its stretches in order and remembers the last pick alone.
    """
    import pyarrow as pa

    rows = df.where(F.col(at).isNotNull()).select(*by, F.col(at).cast("long").alias(at))
    w = Window.partitionBy(*by).orderBy(at)
    fresh = F.coalesce(F.col(at) - F.lag(at).over(w) >= apart, F.lit(True))
    marked = rows.withColumn("_s", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    dealt = marked.repartition(*by, "_s").sortWithinPartitions(*by, "_s", at)

    def run(batches):
        group = last = None
        for b in batches:
            keep = []
            for *own, x, stretch in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (own, stretch) != group:
                    group, last = (own, stretch), None
                stays = last is None or x - last >= apart
                if stays:
                    last = x
                keep.append(stays)
            yield b.filter(pa.array(keep, pa.bool_())).select(range(len(by) + 1))

    return dealt.mapInArrow(run, rows.schema)
