"""Polygon joins and vector files against brute force."""

from __future__ import annotations

import io
import json
import math
import random
import struct
import zipfile

from tidewater.operators import geometry as G
from tidewater.sources import vectors as V

SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]
HOLE = [(3, 3), (7, 3), (7, 7), (3, 7)]
STAR = [(20, 0), (24, 9), (30, 10), (25, 14), (27, 22), (20, 17), (13, 22), (15, 14), (10, 10), (16, 9)]
SHAPES = {1: [SQUARE, HOLE], 2: [STAR], 3: [[(40, 40), (41, 40), (40, 41)], [(50, 50), (52, 50), (51, 53)]]}


def corners(rings):
    return [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]


def polygons(spark):
    return spark.createDataFrame([(k, corners(r)) for k, r in SHAPES.items()], f"zone int, rings {G.RINGS}")


def sides(rings):
    return [(*p, *q) for ring in rings for p, q in zip(ring, ring[1:] + ring[:1], strict=True)]


def inside(x, y, rings):
    return sum(min(y1, y2) <= y < max(y1, y2) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) for x1, y1, x2, y2 in sides(rings) if y1 != y2) % 2 == 1


def distance(x, y, rings):
    if inside(x, y, rings):
        return 0.0
    best = math.inf
    for x1, y1, x2, y2 in sides(rings):
        t = max(0, min(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
        best = min(best, math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1)))
    return best


def scattered(spark, n=400):
    rnd = random.Random(8)
    rows = [(k, rnd.uniform(-8, 58), rnd.uniform(-8, 58)) for k in range(n)] + [(n, 5.0, 5.0), (n + 1, None, 1.0)]
    return rows, spark.createDataFrame(rows, "id int, x double, y double")


def test_holding_and_nearest(spark):
    rows, points = scattered(spark)
    got = {(r.id, r.zone) for r in G.holding(points, polygons(spark), "x", "y", "rings", 4.0).collect()}
    assert got == {(k, z) for k, x, y in rows[:-1] for z, rings in SHAPES.items() if inside(x, y, rings)}
    near = {r.id: (r.zone, round(r.distance, 9)) for r in G.nearest_polygon(points, polygons(spark), "id", "zone", "x", "y", "rings", 5.0, 7.0).collect()}
    want = {}
    for k, x, y in rows[:-1]:
        d, z = min((distance(x, y, rings), z) for z, rings in SHAPES.items())
        if d <= 5.0:
            want[k] = (z, round(d, 9))
    assert near == want and near[400] == (1, 2.0)


def test_shared_area(spark):
    assert G.common_area(corners([SQUARE, HOLE]), corners([SQUARE])) == 84
    assert G.common_area(corners([SQUARE, HOLE]), corners([HOLE])) == 0
    assert G.common_area(corners([SQUARE]), corners([[(5, -5), (15, 5), (5, 15), (-5, 5)]])) == 100
    assert G.common_area(corners([SQUARE]), []) == 0
    assert math.isclose(G.common_area(corners([[(0, 0), (10, 0), (0, 10)]]), corners([[(0, 0), (10, 0), (10, 10)]])), 25)
    rnd = random.Random(3)
    other = [[(rnd.uniform(0, 30), rnd.uniform(0, 25)) for _ in range(5)] for _ in range(6)]
    a = spark.createDataFrame([(k, corners(r)) for k, r in SHAPES.items()], f"a int, left {G.RINGS}")
    b = spark.createDataFrame([(k, corners([r])) for k, r in enumerate(other)], f"b int, right {G.RINGS}")
    got = {(r.a, r.b): r.shared for r in G.intersections(a, b, "left", "right", 6.0).collect()}
    step = 0.05
    for (z, rings), (k, ring) in ((p, q) for p in SHAPES.items() for q in enumerate(other)):
        grid = sum(inside(x * step + 0.011, y * step + 0.013, rings) and inside(x * step + 0.011, y * step + 0.013, [ring]) for x in range(0, 620, 3) for y in range(0, 520, 3)) * (3 * step) ** 2
        assert abs(got.get((z, k), 0.0) - grid) < 2.5
    assert len(got) > 6
    areas = {r.zone: r.area for r in polygons(spark).select("zone", G.polygon_area("rings").alias("area")).collect()}
    assert areas[2] > 0 and areas[3] == 3.5


def plain(rings):
    return [[(c["x"], c["y"]) for c in ring] for ring in rings]


def test_wkb(spark):
    parts = [corners([SQUARE, HOLE]), corners([STAR])]
    df = spark.createDataFrame([(1, parts), (2, None)], "id int, parts array<" + G.RINGS + ">")
    rows = {r.id: r.rings for r in V.from_wkb(V.to_wkb(df, "parts", "wkb"), "wkb").collect()}
    assert rows[2] is None and plain(rows[1]) == [SQUARE, HOLE[::-1], STAR]
    big = b"\x00" + struct.pack(">III", V.WKB_POLYGON, 1, 4) + struct.pack(">8d", 0, 0, 1, 0, 0, 1, 0, 0)
    high = struct.pack("<BIII", 1, 1003, 1, 4) + struct.pack("<12d", 0, 0, 9, 1, 0, 9, 0, 1, 9, 0, 0, 9)
    numbered = struct.pack("<BIIII", 1, 0x20000003, 4326, 1, 4) + struct.pack("<8d", 0, 0, 1, 0, 0, 1, 0, 0)
    for data in (big, high, numbered):
        assert plain(V.parts_of_wkb(data)[0]) == [[(0, 0), (1, 0), (0, 1)]]
    assert V.parts_of_wkb(struct.pack("<BIdd", 1, V.WKB_POINT, 1, 2)) is None


def test_geojson(spark, tmp_path):
    closed = lambda ring: [list(p) for p in [*ring, ring[0]]]
    features = [
        {"type": "Feature", "properties": {"name": "a", "n": 1}, "geometry": {"type": "Polygon", "coordinates": [closed(SQUARE), closed(HOLE)]}},
        {"type": "Feature", "properties": {"name": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [[closed(SQUARE[::-1])], [closed(STAR)]]}},
        {"type": "Feature", "properties": {"name": "c", "n": 3}, "geometry": {"type": "Point", "coordinates": [1.5, 2.5, 9]}},
        {"type": "Feature", "properties": {"name": "d"}, "geometry": None},
    ]
    (tmp_path / "all.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, features)) + "\n")
    for name, lines in (("all", False), ("lines", True)):
        rows = {r.name: r for r in V.geojson(spark, str(tmp_path / f"{name}.json"), "name string, n int", lines).collect()}
        assert [rows[k].n for k in "abcd"] == [1, None, 3, None]
        assert plain(rows["a"].rings) == [SQUARE, HOLE[::-1]] and plain(rows["b"].rings) == [SQUARE, STAR]
        assert (rows["c"].x, rows["c"].y, rows["c"].rings) == (1.5, 2.5, None) and rows["d"].rings is None


def shapefile(records):
    """A .shp and its .dbf of records (name, rings); rings None is a null shape."""
    shp, rows = b"", b""
    for k, (name, rings) in enumerate(records):
        if rings is None:
            body = struct.pack("<i", 0)
        else:
            closed = [[*r, r[0]][::-1] for r in rings]
            points = [p for r in closed for p in r]
            starts = [sum(map(len, closed[:j])) for j in range(len(closed))]
            body = struct.pack("<i4dii", 5, 0, 0, 0, 0, len(closed), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        shp += struct.pack(">ii", k + 1, len(body) // 2) + body
        rows += b" " + name.encode().ljust(8)
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([8]) + b"\0" * 15
    header = struct.pack("<4BIHH", 3, 24, 1, 1, len(records), 32 + 32 + 1, 9) + b"\0" * 20
    return b"\0" * 100 + shp, header + field + b"\r" + rows


def test_zipped_shapefiles(spark, tmp_path):
    shp, dbf = shapefile([("one", [SQUARE, HOLE[::-1]]), ("none", None), ("two", [STAR])])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("layer.shp", shp)
        z.writestr("layer.dbf", dbf)
        z.writestr("layer.prj", "x")
    (tmp_path / "a.zip").write_bytes(out.getvalue())
    rows = V.zipped_shapefiles(spark.read.format("binaryFile").load(str(tmp_path / "*.zip"))).collect()
    assert [(r.layer, r.properties) for r in rows] == [("layer", {"NAME": "one"}), ("layer", {"NAME": "none"}), ("layer", {"NAME": "two"})]
    assert plain(rows[0].rings) == [SQUARE, HOLE[::-1]] and rows[1].rings is None and plain(rows[2].rings) == [STAR]
    assert [r.area for r in V.zipped_shapefiles(spark.read.format("binaryFile").load(str(tmp_path / "*.zip"))).where("rings IS NOT NULL").select(G.polygon_area("rings").alias("area")).collect()][0] == 84
