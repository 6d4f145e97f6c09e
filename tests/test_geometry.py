"""Shapes against plain loops over every point, box, pixel and edge."""

import math
import random

import pytest

from terrabin.functions import grid
from terrabin.operators import geometry

EDGE = "poly long, ring long, x1 double, y1 double, x2 double, y2 double"


def ring(poly, points, k=0):
    return [(poly, k, *map(float, a), *map(float, b)) for a, b in zip(points, points[1:] + points[:1])]


def star(poly, cx, cy, r, corners, seed, k=0, part=1.0):
    g = random.Random(seed)
    at = [(2 * math.pi * i / corners, r * g.uniform(0.4, 1) * part) for i in range(corners)]
    return ring(poly, [(round((cx + q * math.cos(t)) * 8) / 8, round((cy + q * math.sin(t)) * 8) / 8) for t, q in at], k)


def has(edges, x, y):
    return sum((e[3] > y) != (e[5] > y) and x < (e[4] - e[2]) * (y - e[3]) / (e[5] - e[3]) + e[2] for e in edges) % 2 == 1


def cuts(e, w, s, b, n):
    side = [(e[4] - e[2]) * (y - e[3]) - (e[5] - e[3]) * (x - e[2]) for x in (w, b) for y in (s, n)]
    return min(e[2], e[4]) <= b and max(e[2], e[4]) >= w and min(e[3], e[5]) <= n and max(e[3], e[5]) >= s and min(side) <= 0 <= max(side)


SHAPES = [star(1, 20, 20, 18, 400, 1), star(2, 30, 25, 15, 7, 2), star(3, 60, 30, 20, 30, 3) + star(3, 60, 30, 20, 30, 3, 1, 0.25), ring(4, [(5, 40), (15, 40), (15, 50), (5, 50)]), star(5, 22, 22, 1.5, 5, 5)]
ALL = [e for s in SHAPES for e in s]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(ALL, EDGE).repartition(3)


def test_points(spark, edges):
    r = random.Random(7)
    points = [(i, r.randrange(0, 640) / 8, r.randrange(0, 480) / 8) for i in range(600)] + [(9000, 10.0, 45.0)] * 3 + [(9001, 5.0, 40.0), (9002, 15.0, 50.0), (9003, 200.0, 1.0)]
    got = sorted(map(tuple, geometry.inside(spark.createDataFrame(points, "poly_of long, px double, py double"), edges, 7.0).select("poly_of", "poly").collect()))
    assert got == sorted((i, s[0][0]) for i, x, y in points for s in SHAPES if has(s, x, y))
    assert got.count((9000, 4)) == 3  # repeated points are kept


def test_a_polygon_of_many_edges_adds_few_to_a_point(spark):
    circle = [(500 + 400 * math.cos(t / 20000 * 2 * math.pi), 500 + 400 * math.sin(t / 20000 * 2 * math.pi)) for t in range(20000)]
    big = spark.createDataFrame(ring(1, circle), EDGE)
    b = geometry.extents(big).first()
    assert b.bands > 500
    dealt = big.join(geometry.extents(big), "poly").selectExpr("floor((least(y1, y2) - s) / (n - s) * bands) as a", "floor((greatest(y1, y2) - s) / (n - s) * bands) as b")
    assert dealt.selectExpr("sum(b - a + 1)").first()[0] <= 2 * 20000 + b.bands


def test_squares(spark, edges):
    boxes = [(x, y, float(x), float(y), x + 4.0, y + 4.0) for x in range(0, 90, 4) for y in range(0, 60, 4)]
    got = sorted(map(tuple, geometry.meeting(spark.createDataFrame(boxes, "x1 long, y long, w double, s double, e double, n double"), edges, 4.0).select("x1", "y", "poly").collect()))
    want = sorted((b[0], b[1], s[0][0]) for b in boxes for s in SHAPES if any(cuts(e, *b[2:]) for e in s) or has(s, b[2], b[3]))
    assert got == want
    assert (12, 44, 4) in got and (8, 36, 4) in got  # inside whole; an edge in common


def test_tile_in_a_long_lines_box_but_far_from_it(spark):
    lines = spark.createDataFrame([(1, 0.0, 0.0, 400.0, 300.0), (2, 50.0, 50.0, 50.0, 50.0), (3, 0.0, 100.0, 400.0, 100.0)], "line long, x1 double, y1 double, x2 double, y2 double")
    tiles = [(1, 300.0, 10.0, 310.0, 20.0, 5.0), (2, 196.0, 150.0, 206.0, 160.0, 5.0), (3, 55.0, 55.0, 60.0, 60.0, 5.0), (4, 55.1, 55.0, 60.0, 60.0, 5.0), (5, 300.0, 105.0, 310.0, 110.0, 5.0), (6, 216.0, 148.0, 220.0, 152.0, 5.0)]
    got = sorted(map(tuple, geometry.near_lines(spark.createDataFrame(tiles, "tile long, w double, s double, e double, n double, pad double"), lines, 16.0).collect()))
    ends = {1: (0, 0, 0.0, 0.0, 400.0, 300.0), 2: (0, 0, 50.0, 50.0, 50.0, 50.0), 3: (0, 0, 0.0, 100.0, 400.0, 100.0)}
    assert got == sorted((t[0], k) for t in tiles for k, e in ends.items() if cuts(e, t[1] - 5, t[2] - 5, t[3] + 5, t[4] + 5))
    assert (1, 1) not in got and (3, 2) in got and (4, 2) not in got and (5, 3) in got


def test_pixels(spark, edges):
    layers = [(1, 3, 1), (2, 2, 9), (3, 1, 1), (4, 3, 0), (5, 3, 2)]
    got = {(r.x, r.y): (r.grp, r.legend) for r in geometry.filled(edges, spark.createDataFrame(layers, "poly long, grp long, legend long"), 0, 0, 70, 45).collect()}
    want = {}
    for x in range(71):
        for y in range(46):
            if over := [(g, v) for s, (_, g, v) in zip(SHAPES, layers) if has(s, x, y)]:
                want[x, y] = max(over)
    assert got == want
    some = random.Random(3).sample(ALL, 40)
    wet = {(r.x, r.y) for r in geometry.touched(spark.createDataFrame(some, EDGE)).collect()}
    assert wet == {(x, y) for x in range(-5, 90) for y in range(-5, 70) if any(cuts(e, x - 0.5, y - 0.5, x + 0.5, y + 0.5) for e in some)}


def test_areas(spark):
    box = ring(1, [(135, 35), (136, 35), (136, 36), (135, 36)]) + ring(1, [(135.25, 35.25), (135.25, 35.5), (135.5, 35.5), (135.5, 35.25)], 1)
    e = spark.createDataFrame(box, EDGE)
    assert geometry.planar_areas(e).first().area == pytest.approx(1 - 1 / 16)
    rows = spark.range(12000).selectExpr("35 + (id + 0.5) / 12000 as lat")
    pixel = rows.select(grid.pixel_area_km2(rows.lat).alias("a")).where("true")
    whole = 12000 * pixel.agg({"a": "sum"}).first()[0]
    hole = 3000 * rows.where("lat > 35.25 and lat < 35.5").select(grid.pixel_area_km2(rows.lat).alias("a")).agg({"a": "sum"}).first()[0]
    assert geometry.ring_areas(e).first().km2 == pytest.approx(whole - hole, rel=1e-9)


def test_components(spark, edges):
    r = random.Random(2)
    owned = edges.selectExpr("*", "cast(poly / 4 as int) as pref")
    cells = [(x, y, r.randrange(2), x * 4.0, y * 4.0, x * 4.0 + 4, y * 4.0 + 4) for x in range(22) for y in range(14)]
    got = {(c.gx, c.gy): (c.poly, c.how) for c in geometry.components(spark.createDataFrame(cells, "gx long, gy long, pref int, w double, s double, e double, n double"), owned, 4.0).collect()}
    for gx, gy, pref, *b in cells:
        mine = [s for s in SHAPES if s[0][0] // 4 == pref]
        centre = [s[0][0] for s in mine if has(s, b[0] + 2, b[1] + 2)]
        near = [s[0][0] for s in mine if any(cuts(e, *b) for e in s) or has(s, b[0], b[1])]
        want = (min(centre), "centre") if centre else (near[0], "coast") if len(near) == 1 else (None, "ambiguous" if near else "none")
        assert got[gx, gy] == want
    assert {"centre", "coast", "ambiguous", "none"} == {h for _, h in got.values()}


def test_empty(spark, edges):
    none = spark.createDataFrame([], EDGE)
    points = spark.createDataFrame([(1, 1.0, 1.0)], "i long, px double, py double")
    assert geometry.inside(points, none, 4.0).count() == 0 and geometry.inside(points.where("i = 2"), edges, 4.0).count() == 0
    flat = spark.createDataFrame([(1, 0, 0.0, 1.0, 4.0, 1.0), (1, 0, 4.0, 1.0, 0.0, 1.0)], EDGE)  # a polygon without height
    assert geometry.inside(points, flat, 4.0).count() == 0 and geometry.ring_areas(flat).first().km2 == 0


def test_places_of_several_prefectures_are_compared_once(spark, edges, monkeypatch):
    """Cells of a place, whatever their prefecture, meet the polygons of their own; and so they do in many small tasks."""
    from terrabin import shipping

    owned = edges.selectExpr("*", "cast(poly / 4 as int) as pref")
    cells = [(x, y, p, x * 4.0, y * 4.0, x * 4.0 + 4, y * 4.0 + 4) for x in range(12) for y in range(12) for p in (0, 1, 2)]
    df = spark.createDataFrame(cells, "gx long, gy long, pref int, w double, s double, e double, n double")
    want = sorted((gx, gy, p, s[0][0]) for gx, gy, p, *b in cells for s in SHAPES if s[0][0] // 4 == p and (any(cuts(e, *b) for e in s) or has(s, b[0], b[1])))
    seen = []
    whole = geometry.meeting
    monkeypatch.setattr(geometry, "meeting", lambda boxes, *a: seen.append(boxes.count()) or whole(boxes, *a))
    got = lambda: sorted((r.gx, r.gy, r.pref, r.poly) for r in geometry.meeting_own(df, owned, 4.0).collect())
    assert got() == want and seen == [144]
    monkeypatch.setattr(shipping, "TASK_ROWS", 10)
    assert shipping.spread(df, 144, "gx").rdd.getNumPartitions() == 15 and got() == want
