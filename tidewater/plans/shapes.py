"""Queries of polygons and vector files: nearest polygons, shared areas, GeoJSON and WKB there and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lines as L
from ..operators import geometry as G
from ..sources import vectors as V
from ..sources.tables import table
from .analysing import rnd
from .registry import query
from .streams import shared

#: Corners of an outer ring and of a hole around a zone's centre, and of a second part beside it.
OUTER = [(-12.0, -9.0), (13.0, -7.0), (10.0, 12.0), (1.0, 2.0), (-11.0, 10.0)]
HOLE = [(-4.0, -4.0), (3.0, -5.0), (0.0, 0.0)]
ISLAND = [(15.0, 3.0), (19.0, 4.0), (16.0, 8.0)]
RINGS = [OUTER, HOLE, ISLAND]

POINTS = "SELECT c_custkey AS id, c_acctbal / 100 AS x, (c_custkey % 1000) / 10.0 AS y FROM customer"
CORNERS = ", ".join(f"({r}, {k}, {len(ring)}, {x}, {y})" for r, ring in enumerate(RINGS) for k, (x, y) in enumerate(ring))
EDGES = f"""c AS ({POINTS}), o AS (SELECT * FROM (VALUES {CORNERS}) v(r, i, m, x, y)),
    v AS (SELECT n_nationkey AS zone, r, i, m, n_nationkey * 17 % 100 + x AS x, n_nationkey * 29 % 100 + y AS y FROM nation CROSS JOIN o),
    e AS (SELECT a.zone, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON b.zone = a.zone AND b.r = a.r AND b.i = (a.i + 1) % a.m),
    h AS (SELECT id, zone FROM c JOIN e ON y1 <> y2 AND c.y >= least(y1, y2) AND c.y < greatest(y1, y2) AND c.x < x1 + (c.y - y1) * (x2 - x1) / (y2 - y1) GROUP BY 1, 2 HAVING count(*) % 2 = 1)"""


def customers(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") % 1000 / 10).alias("y"))


def zones(spark, d):
    """Zones of two parts, the first with a hole, as arrays of rings by part."""
    corner = lambda dx, dy: F.struct((F.col("n_nationkey") * 17 % 100 + dx).alias("x"), (F.col("n_nationkey") * 29 % 100 + dy).alias("y"))
    ring = lambda corners: F.array(*(corner(*c) for c in corners))
    parts = F.array(F.array(ring(OUTER), ring(HOLE)), F.array(ring(ISLAND)))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("zone"), "n_name", parts.alias("parts"))


@query("scan_geojson", f"WITH {EDGES} SELECT h.id, h.zone, n_name FROM h JOIN nation ON n_nationkey = h.zone")
def scan_geojson(spark, d):
    """Zones written as GeoJSON, a feature a line, read back with their properties, and joined to the points that they hold."""
    path = shared(spark)
    V.to_geojson(zones(spark, d), "parts").write.text(path)
    read = V.geojson(spark, path, "zone int, n_name string", lines=True).select("zone", "n_name", "rings")
    return G.holding(customers(spark, d), read, "x", "y", "rings", 10.0).select("id", "zone", "n_name")


@query("scan_geoparquet", f"WITH {EDGES} SELECT zone, count(*) AS n FROM h GROUP BY 1")
def scan_geoparquet(spark, d):
    """Zones as Parquet with a geometry of well-known bytes; points counted by the zone that holds them."""
    path = shared(spark)
    V.to_wkb(zones(spark, d).select("zone", "parts"), "parts").write.parquet(path)
    return G.holding(customers(spark, d), V.geoparquet(spark, path), "x", "y", "rings", 10.0).groupBy("zone").agg(F.count(F.lit(1)).alias("n"))


@query("nearest_polygon", f"""WITH {EDGES}, t AS (SELECT id, zone, x, y, x1, y1, x2, y2, greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS t FROM c CROSS JOIN e),
    s AS (SELECT id, zone, sqrt((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2) AS distance FROM t),
    b AS (SELECT id, zone, distance FROM s WHERE distance <= 4.0 UNION ALL SELECT id, zone, 0.0 FROM h)
    SELECT id, round(min(distance), 6) AS distance, arg_min(zone, (distance, zone)) AS zone FROM b GROUP BY 1""")
def nearest_polygon(spark, d):
    z = zones(spark, d).select("zone", G.oriented(F.col("parts")).alias("rings"))
    near = G.nearest_polygon(customers(spark, d), z, "id", "zone", "x", "y", "rings", within=4.0, size=10.0)
    return near.select("id", "zone", rnd("distance", "distance"))


BOXES = "SELECT s_suppkey AS id, s_acctbal / 100 AS x, (s_suppkey * 7 % 1000) / 10.0 AS y, 3.0 + s_suppkey % 4 AS w, 2.0 + s_suppkey % 3 AS h FROM supplier"


@query("intersection_share", f"""WITH b AS ({BOXES}), p AS (SELECT n_nationkey AS zone, n_nationkey * 17 % 100 AS x, n_nationkey * 29 % 100 AS y FROM nation),
    l AS (SELECT zone, x, y, 8.0 AS w, 3.0 AS h FROM p UNION ALL SELECT zone, x, y + 3, 2.0, 6.0 FROM p),
    a AS (SELECT id, zone, (least(b.x + b.w, l.x + l.w) - greatest(b.x, l.x)) * (least(b.y + b.h, l.y + l.h) - greatest(b.y, l.y)) AS a, b.w * b.h AS whole FROM b JOIN l
        ON b.x < l.x + l.w AND l.x < b.x + b.w AND b.y < l.y + l.h AND l.y < b.y + b.h)
    SELECT id, zone, round(sum(a) / any_value(whole), 9) AS share FROM a GROUP BY 1, 2""")
def intersection_share(spark, d):
    """The share of each supplier's box that a zone covers; zones have the shape of an L."""
    box = lambda x, y, corners: F.array(F.array(*(F.struct((x + cx).cast("double").alias("x"), (y + cy).cast("double").alias("y")) for cx, cy in corners)))
    w, h = 3.0 + F.col("s_suppkey") % 4, 2.0 + F.col("s_suppkey") % 3
    x, y = F.col("s_acctbal") / 100, F.col("s_suppkey") * 7 % 1000 / 10
    zero = F.lit(0.0)
    boxes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), box(x, y, [(zero, zero), (w, zero), (w, h), (zero, h)]).alias("box"))
    shape = [(0.0, 0.0), (8.0, 0.0), (8.0, 3.0), (2.0, 3.0), (2.0, 9.0), (0.0, 9.0)]
    ells = table(spark, d, "nation").select(F.col("n_nationkey").alias("zone"), box(F.col("n_nationkey") * 17 % 100, F.col("n_nationkey") * 29 % 100, [(F.lit(a), F.lit(b)) for a, b in shape]).alias("ell"))
    areas = boxes.withColumn("area", G.polygon_area("box"))
    return G.intersections(areas, ells, "box", "ell", 10.0).select("id", "zone", rnd(F.col("shared") / F.col("area"), "share", 9))


@query("line_codes", f"""WITH o AS (SELECT * FROM (VALUES {", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(OUTER))}) v(i, x, y))
    SELECT n_nationkey AS zone, i, round((n_nationkey * 17 % 100 + x) / 7, 5) AS x, round((n_nationkey * 29 % 100 + y) / 7, 5) AS y FROM nation CROSS JOIN o""")
def line_codes(spark, d):
    """The outer rings of the zones as short texts and back."""
    line = F.transform(F.col("parts")[0][0], lambda c: F.struct((c["x"] / 7).alias("x"), (c["y"] / 7).alias("y")))
    texts = zones(spark, d).select("zone", line.alias("line")).select("zone", L.encoded("line").alias("text"))
    return texts.select("zone", F.posexplode(L.decoded("text")).alias("i", "c")).select("zone", "i", rnd("c.x", "x", 5), rnd("c.y", "y", 5))
