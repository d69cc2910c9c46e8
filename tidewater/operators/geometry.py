"""Polygons in the plane as columns: which hold a point, which is nearest, and how much of one another covers.

A geometry is one column `rings`: an array of rings, each an array of corners {x, y} without its first corner again. Parts and
holes are all rings of the one array, and a place is inside where a ray crosses the sides of all rings an odd number of times.
Pairs meet in grid cells as equi-joins, so no side is collected and hot cells are split by Spark as any skewed join key is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import cell

RINGS = "array<array<struct<x: double, y: double>>>"


def sides(rings: str) -> Column:
    """All sides of all rings, as structs x1, y1, x2, y2."""
    turned = lambda r: F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))
    side = lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
    return F.flatten(F.transform(rings, lambda r: F.zip_with(r, turned(r), side)))


def ends(rings: str, at: str) -> tuple[Column, Column]:
    """Least and greatest coordinate of a geometry; null without corners."""
    every = F.transform(F.flatten(F.col(rings)), lambda p: p[at])
    return F.array_min(every), F.array_max(every)


def twice_area(ring: Column) -> Column:
    """Twice a ring's area, positive if it runs against the clock."""
    turned = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)


def oriented(parts: Column) -> Column:
    """Rings of parts (arrays of rings, the outer ring first): outer ones against the clock, holes with it."""
    run = lambda ring, outer: F.when((twice_area(ring) > 0) == outer, ring).otherwise(F.reverse(ring))
    return F.flatten(F.transform(parts, lambda part: F.transform(part, lambda ring, k: run(ring, k == 0))))


def polygon_area(rings: str) -> Column:
    """Area of oriented rings."""
    return F.aggregate(F.transform(rings, twice_area), F.lit(0.0), lambda s, v: s + v) / 2


def covered(polygons: DataFrame, rings: str, size: float) -> DataFrame:
    """Polygons once for each grid cell _cx, _cy that their box covers."""
    (x0, x1), (y0, y1) = ends(rings, "x"), ends(rings, "y")
    out = polygons.where(F.size(F.flatten(F.col(rings))) > 0)
    return out.withColumn("_cx", F.explode(F.sequence(cell(x0, size), cell(x1, size)))).withColumn("_cy", F.explode(F.sequence(cell(y0, size), cell(y1, size))))


def holding(points: DataFrame, polygons: DataFrame, x: str, y: str, rings: str, size: float) -> DataFrame:
    """Points with each polygon that holds them, holes and several parts included. size: of the grid's cells."""
    met = points.withColumn("_cx", cell(F.col(x), size)).withColumn("_cy", cell(F.col(y), size)).join(covered(polygons, rings, size), ["_cx", "_cy"])

    def crossed(s):
        between = (F.least(s["y1"], s["y2"]) <= F.col(y)) & (F.col(y) < F.greatest(s["y1"], s["y2"]))
        return between & (F.col(x) < s["x1"] + (F.col(y) - s["y1"]) * (s["x2"] - s["x1"]) / F.nullif(s["y2"] - s["y1"], F.lit(0.0)))

    return met.where(F.size(F.filter(sides(rings), crossed)) % 2 == 1).drop("_cx", "_cy", rings)


def to_side(x: Column, y: Column, s: Column) -> Column:
    """Distance of a point to a side."""
    dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
    along = F.coalesce(((x - s["x1"]) * dx + (y - s["y1"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.hypot(x - s["x1"] - t * dx, y - s["y1"] - t * dy)


def nearest_polygon(points: DataFrame, polygons: DataFrame, point: str, key: str, x: str, y: str, rings: str, within: float, size: float) -> DataFrame:
    """Each point's nearest polygon at most `within` away, and the distance (0 inside); of equal distances the lesser key.

    A side stands in the cells of its box grown by `within`, so that a point meets each side in reach in its own cell, once. The
    least over a point's sides is combined before it is shuffled. point names points; points without a polygon in reach are left out.
    """
    edges = polygons.select(key, F.explode(sides(rings)).alias("_s"))
    low = lambda a, b: cell(F.least(a, b) - within, size)
    high = lambda a, b: cell(F.greatest(a, b) + within, size)
    s = F.col("_s")
    reach = edges.withColumn("_cx", F.explode(F.sequence(low(s["x1"], s["x2"]), high(s["x1"], s["x2"]))))
    reach = reach.withColumn("_cy", F.explode(F.sequence(low(s["y1"], s["y2"]), high(s["y1"], s["y2"]))))
    own = points.select(point, x, y).withColumn("_cx", cell(F.col(x), size)).withColumn("_cy", cell(F.col(y), size))
    beside = own.join(reach, ["_cx", "_cy"]).select(point, key, to_side(F.col(x), F.col(y), s).alias("distance")).where(F.col("distance") <= within)
    inside = holding(points.select(point, x, y), polygons.select(key, rings), x, y, rings, size).select(point, key, F.lit(0.0).alias("distance"))
    best = beside.unionByName(inside).groupBy(point).agg(F.min(F.struct("distance", key)).alias("_best"))
    return points.join(best, point).select(*points.columns, f"_best.{key}", "_best.distance")


def common_area(a: list[list[dict]], b: list[list[dict]]) -> float:
    """Area that two geometries share, by odd crossings in each: exact up to rounding, for any rings.

    Between two heights where neither a corner nor a crossing of sides lies, the shared width changes linearly, so a strip's area is
    its height times the width in its middle.
    """
    edges = []
    for rings in (a, b):
        own = np.array([(p["x"], p["y"], q["x"], q["y"]) for r in rings for p, q in zip(r, r[1:] + r[:1], strict=True)], float).reshape(-1, 4)
        edges.append(own[own[:, 1] != own[:, 3]])
    every = np.concatenate(edges)
    if not all(map(len, edges)):
        return 0.0
    low, high = (f(g(e[:, 1::2]) for e in edges) for f, g in ((max, np.min), (min, np.max)))  # of what both reach
    heights = [every[:, 1], every[:, 3]]
    p, d = every[:, :2], every[:, 2:] - every[:, :2]
    cross = d[:, None, 0] * d[None, :, 1] - d[:, None, 1] * d[None, :, 0]
    apart = p[None] - p[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (apart[..., 0] * d[None, :, 1] - apart[..., 1] * d[None, :, 0]) / cross
    met = (cross != 0) & (t > 0) & (t < 1)
    heights.append((p[:, None, 1] + np.where(met, t, 0) * d[:, None, 1])[met])
    ys = np.unique(np.concatenate(heights))
    ys = ys[(ys >= low) & (ys <= high)]
    total = 0.0
    for y0, y1 in zip(ys[:-1], ys[1:], strict=True):
        y = (y0 + y1) / 2
        spans = []
        for e in edges:
            on = e[(np.minimum(e[:, 1], e[:, 3]) < y) & (y < np.maximum(e[:, 1], e[:, 3]))]
            xs = np.sort(on[:, 0] + (y - on[:, 1]) * (on[:, 2] - on[:, 0]) / (on[:, 3] - on[:, 1]))
            spans.append((xs[: len(xs) // 2 * 2 : 2], xs[1::2]))
        (a0, a1), (b0, b1) = spans
        if len(a0) and len(b0):
            width = np.minimum(a1[:, None], b1) - np.maximum(a0[:, None], b0)
            total += float((y1 - y0) * width[width > 0].sum())
    return total


def intersections(a: DataFrame, b: DataFrame, a_rings: str, b_rings: str, size: float) -> DataFrame:
    """Pairs of geometries that share area, with it as `shared`, and all other columns of both, whose names must differ.

    A pair meets in every cell that both boxes cover, and counts in the one that holds the lower left corner of what the boxes share,
    so nothing is made distinct. Only then its shared area is taken.
    """
    met = covered(a, a_rings, size).join(covered(b, b_rings, size), ["_cx", "_cy"])
    boxes = [(ends(a_rings, k), ends(b_rings, k)) for k in ("x", "y")]
    corner = [F.greatest(p[0], q[0]) for p, q in boxes]
    overlap = [F.least(p[1], q[1]) > c for (p, q), c in zip(boxes, corner, strict=True)]
    once = met.where((cell(corner[0], size) == F.col("_cx")) & (cell(corner[1], size) == F.col("_cy")) & overlap[0] & overlap[1]).drop("_cx", "_cy")
    keep = [c for c in once.columns if c not in (a_rings, b_rings)]
    rows = once.select(*keep, a_rings, b_rings)
    schema = rows.select(*keep, F.lit(0.0).alias("shared")).schema

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                pairs = zip(part.column(len(keep)).to_pylist(), part.column(len(keep) + 1).to_pylist(), strict=True)
                shared = pa.array([common_area(p, q) for p, q in pairs], pa.float64())
                yield pa.RecordBatch.from_arrays([*(part.column(j) for j in range(len(keep))), shared], names=[*keep, "shared"])

    return rows.mapInArrow(run, schema).where("shared > 0")
