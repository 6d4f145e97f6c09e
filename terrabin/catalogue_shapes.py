"""Queries of points, squares, tiles and pixels against polygons and lines that are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrabin.catalogue import _b, query
from terrabin.functions import grid
from terrabin.operators import geometry, stencil

_CUT = "(y1 > py) <> (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1"


def _inside(points: str, keys: str) -> str:
    return f"(select {keys}, poly from (select {keys}, poly, pref_of, count(*) filter (where y1 <> y2 and {_CUT}) as k from {points} p cross join (select *, pref as pref_of from shape) s group by {keys}, poly, pref_of) h where k % 2 = 1)"


_PX = "(select x, y, cast(x as double) as px, cast(y as double) as py from px)"


def _points(px):
    return px.select("x", "y", F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))


@query("J9_point_in_polygon", f"select x, y, poly from {_inside(_PX, 'x, y')} q", "px", "shape")
def _(px, shape):
    return geometry.inside(_points(px), shape, 16.0).select("x", "y", "poly")


_SQUARE = "select distinct gx, gy, pref, (gx - 12000) * 5e0 as w, (gy - 15000) * 5e0 as s, (gx - 11999) * 5e0 as e, (gy - 14999) * 5e0 as n from cell"
_SIDE = lambda x, y: f"(x2 - x1) * ({y} - y1) - (y2 - y1) * ({x} - x1)"
_CORNERS = ", ".join(_SIDE(x, y) for x in "we" for y in "sn")
_TOUCH = f"least(x1, x2) <= e and greatest(x1, x2) >= w and least(y1, y2) <= n and greatest(y1, y2) >= s and least({_CORNERS}) <= 0 and greatest({_CORNERS}) >= 0"
_MEET = f"""sq as materialized ({_SQUARE}), own as (select distinct poly, pref as owner from shape),
m as materialized (select distinct gx, gy, sq.pref, poly from sq join shape sh on {_TOUCH}
  union select gx, gy, pref, poly from {_inside('(select gx, gy, pref, w as px, s as py from sq)', 'gx, gy, p.pref').replace('select gx, gy, p.pref, poly from (', 'select gx, gy, pref, poly from (')} i)"""


def _squares(cell):
    at = lambda c, zero: (F.col(c) - zero) * F.lit(5.0)
    return cell.select("gx", "gy", "pref").distinct().select("gx", "gy", "pref", at("gx", 12000).alias("w"), at("gy", 15000).alias("s"), at("gx", 11999).alias("e"), at("gy", 14999).alias("n"))


@query("J10_exactly_one", f"with {_MEET} select gx, gy, pref, min(poly) as poly from m join own using (poly) where owner = pref group by 1, 2, 3 having count(*) = 1", "cell", "shape")
def _(cell, shape):
    return geometry.exactly_one(geometry.meeting_own(_squares(cell), shape, 5.0), ["gx", "gy", "pref"])


@query("J10_cell_components", f"""with {_MEET},
c as (select gx, gy, pref, min(poly) as poly from {_inside('(select gx, gy, pref, (w + e) / 2 as px, (s + n) / 2 as py from sq)', 'gx, gy, p.pref').replace('select gx, gy, p.pref, poly from (', 'select gx, gy, pref, poly from (')} i join own using (poly) where owner = pref group by 1, 2, 3),
o as (select gx, gy, pref, min(poly) as poly, count(*) as k from m join own using (poly) where owner = pref group by 1, 2, 3)
select gx, gy, pref, coalesce(c.poly, case when k = 1 then o.poly end) as poly, case when c.poly is not null then 'centre' when k = 1 then 'coast' when k > 1 then 'ambiguous' else 'none' end as how
from sq left join c using (gx, gy, pref) left join o using (gx, gy, pref)""", "cell", "shape")  # fmt: skip
def _(cell, shape):
    return geometry.components(_squares(cell), shape, 5.0).select("gx", "gy", "pref", "poly", "how")


# degrees of pixel coordinates: 1600 pixels a degree of longitude, 2400 a degree of latitude
_LON, _LAT = "(137.5 + {} / 1600e0)", "(31.25 + {} / 2400e0)"


def _degrees(shape):
    return shape.select("poly", "pref", "ring", *((F.lit(137.5) + F.col(c) / 1600.0).alias(c) for c in ("x1", "x2")), *((F.lit(31.25) + F.col(c) / 2400.0).alias(c) for c in ("y1", "y2")))


_U = lambda lat: f"(sin(radians({lat})) / (2 * (1 - {grid.E2!r} * pow(sin(radians({lat})), 2))) + atanh(sqrt({grid.E2!r}) * sin(radians({lat}))) / (2 * sqrt({grid.E2!r})))"
_AREAS = f"""select poly, pref, sum(case when ring = 0 then a else -a end) * {grid.AXIS * grid.AXIS * (1 - grid.E2) / 1e6!r} as km2
from (select poly, pref, ring, abs(sum(radians(({_LON.format('x1')} + {_LON.format('x2')}) / 2) * ({_U(_LAT.format('y2'))} - {_U(_LAT.format('y1'))}))) as a from shape group by 1, 2, 3) r group by poly, pref"""


@query("A23_ring_areas", f"select poly, pref, round(km2, 6) as km2 from ({_AREAS}) a", "shape")
def _(shape):
    return geometry.ring_areas(_degrees(shape), "pref").select("poly", "pref", F.round("km2", 6).alias("km2"))


_MAIN = f"select pref, min(poly) as poly from (select pref, poly, km2, max(km2) over (partition by pref) as top from ({_AREAS}) a) q where km2 = top group by pref"


def _mainland(shape):
    return geometry.largest(geometry.ring_areas(_degrees(shape), "pref").withColumnRenamed("km2", "area"))


@query("A23_largest_polygon", _MAIN, "shape")
def _(shape):
    return _mainland(shape)


_ISLAND = "(select c_custkey, c_custkey * 29 % 1200 * 125e-3 as px, c_custkey / 15e0 + c_custkey % 8 * 125e-3 as py from customer)"


@query("J11_island_points", f"with main as ({_MAIN}) select c_custkey, min(poly) as poly from {_inside(_ISLAND, 'c_custkey')} q group by c_custkey having count(*) = 1 and min(poly) not in (select poly from main)", "customer", "shape")
def _(customer, shape):
    key = F.col("c_custkey")
    points = customer.select("c_custkey", (key * 29 % 1200 * 0.125).alias("px"), (key / 15.0 + key % 8 * 0.125).alias("py"))
    found = geometry.exactly_one(geometry.inside(points, shape, 16.0), ["c_custkey"])
    return found.join(_mainland(shape).select("poly"), "poly", "left_anti").select("c_custkey", "poly")


_METRES = f"""select tile, w, s, e, n, 60 / least({grid.AXIS} * (1 - {grid.E2!r}) / pow(q, 1.5) * pi() / 180 / 12000, {grid.AXIS} / sqrt(q) * cos(phi) * pi() / 180 / 12000) as pad
from (select *, radians(31.25 + (s + n) / 4800) as phi, 1 - {grid.E2!r} * pow(sin(radians(31.25 + (s + n) / 4800)), 2) as q from (
  select distinct floor(x / 16e0) * 1000 + floor(y / 16e0) as tile, floor(x / 16e0) * 16e0 as w, floor(y / 16e0) * 16e0 as s, floor(x / 16e0) * 16e0 + 16 as e, floor(y / 16e0) * 16e0 + 16 as n from px) t) u"""


@query("J12_tiles_near_lines", f"select distinct cast(tile as bigint) as tile, line from (select tile, w - pad as w, s - pad as s, e + pad as e, n + pad as n from ({_METRES}) m) t join coast on {_TOUCH}", "px", "coast")
def _(px, coast):
    fx, fy = F.floor(F.col("x") / 16.0), F.floor(F.col("y") / 16.0)
    tiles = px.select((fx * 1000 + fy).cast("bigint").alias("tile"), (fx * 16.0).alias("w"), (fy * 16.0).alias("s")).distinct().withColumns({"e": F.col("w") + 16, "n": F.col("s") + 16})
    m = grid.metres(F.lit(31.25) + (F.col("s") + F.col("n")) / 4800.0)
    return geometry.near_lines(tiles.withColumn("m", m).withColumn("pad", 60 / F.least("m.dy", "m.dx")), coast, 32.0)


@query("W5_rasterised", f"""select x, y, max(top)[1] as grp, max(top)[2] as legend from (select x, y, [poly % 5 + 1, poly % 7] as top from {_inside(_PX, 'x, y')} i) q group by x, y""", "px", "shape")
def _(px, shape):
    layers = shape.select("poly", (F.col("poly") % 5 + 1).alias("grp"), (F.col("poly") % 7).alias("legend")).distinct()
    top = px.agg(F.max("y")).first()[0]
    pixels = geometry.filled(shape, layers, 0, 0, 149, -1 if top is None else top)
    return pixels.join(px.select("x", "y"), ["x", "y"], "left_semi").select("x", "y", _b("grp"), _b("legend"))


_WET = f"select distinct x, y from (select x, y, x - 5e-1 as w, y - 5e-1 as s, x + 5e-1 as e, y + 5e-1 as n from px) p join coast on {_TOUCH}"


@query("W5_touched_pixels", _WET, "px", "coast")
def _(px, coast):
    return geometry.touched(coast).join(px.select("x", "y"), ["x", "y"], "left_semi")


@query("J21_coast_bins", f"""with t as materialized ({_WET})
select p.x, p.y, cast(case when d2 <= 1 then 0 when d2 <= 6.25 then 1 when d2 <= 25 then 2 else 3 end as bigint) as bin
from px p left join (select a.x, a.y, min((a.x - t.x) * (a.x - t.x) + (a.y - t.y) * (a.y - t.y)) as d2 from px a join t on t.x between a.x - 5 and a.x + 5 and t.y between a.y - 5 and a.y + 5 group by a.x, a.y) q on q.x = p.x and q.y = p.y""", "px", "coast")  # fmt: skip
def _(px, coast):
    wet = geometry.touched(coast).withColumn("wet", F.lit(True))
    return stencil.distance_bins(px.select("x", "y").join(wet, ["x", "y"], "left"), F.coalesce("wet", F.lit(False)))
