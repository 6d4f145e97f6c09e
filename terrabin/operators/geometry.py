"""Points, squares, boxes and pixels against polygons and lines, without a geometry library.

Polygons are rows of edges (poly, x1, y1, x2, y2), rings closed, holes included; lines are rows of segments (line, ...).
No join is on a shape alone:

* A point meets a polygon's edges by bands: horizontal strips of the polygon, as high as its edges are on average, so that
  there are at most twice as many (edge, band) rows as edges, and a point meets the edges of one strip.  It is inside if an
  odd number of them crosses the ray to its right; a point on an edge counts by that rule, not as touching.
* Boxes that several prefectures share are compared once, as places; prefectures meet the polygons of their places.
* Squares, tiles and pixels meet edges in the grid buckets that an edge crosses, not in those of its box; an exact test of
  box and segment follows.  Boxes that a shape contains whole are told by a corner.
* Filling follows scan lines: an edge gives a crossing to each line it spans, and pairs of crossings are runs of pixels.

Coordinates are planar (longitude and latitude, or pixels); areas are planar or on the ellipsoid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrabin.functions.grid import AXIS, E2, zone
from terrabin.shipping import spread

#: Widens an edge's range of buckets against rounding; the exact test follows.
_SLACK = 1e-9


def _buckets(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low).cast("bigint"), F.floor(high).cast("bigint")))


def _low(a: str, b: str) -> Column:
    return F.least(a, b)


def _high(a: str, b: str) -> Column:
    return F.greatest(a, b)


def extents(edges: DataFrame, key: str = "poly") -> DataFrame:
    """(key, w, s, e, n, bands) of every shape; bands is its number of strips."""
    tall = F.col("n") - F.col("s")
    box = edges.groupBy(key).agg(
        F.min(_low("x1", "x2")).alias("w"), F.min(_low("y1", "y2")).alias("s"), F.max(_high("x1", "x2")).alias("e"), F.max(_high("y1", "y2")).alias("n"),
        F.avg(F.abs(F.col("y2") - F.col("y1"))).alias("mean"),
    )
    return box.withColumn("bands", F.when(tall > 0, F.floor(tall / F.col("mean"))).otherwise(1).cast("bigint")).drop("mean")


def _band(y: Column) -> Column:
    """The strip of an ordinate within a shape's extent; grows with y."""
    at = F.floor((y - F.col("s")) / (F.col("n") - F.col("s")) * F.col("bands")).cast("bigint")
    return F.when(F.col("n") > F.col("s"), F.least(F.greatest(at, F.lit(0)), F.col("bands") - 1)).otherwise(F.lit(0).cast("bigint"))


def crossing(y: Column) -> Column:
    """Where an edge that spans y has that ordinate."""
    return (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")


def inside(points: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """points (px, py and own columns) with poly, once for each polygon they are in; repeated points are kept.

    Polygons whose boxes meet a bucket of the size are candidates of its points."""
    shapes = extents(edges)
    at = shapes.withColumn("bx", _buckets(F.col("w") / size, F.col("e") / size)).withColumn("by", _buckets(F.col("s") / size, F.col("n") / size))
    rows, px, py = points.count(), F.col("_point.px"), F.col("_point.py")
    p = points.select(F.struct(*points.columns).alias("_point"), F.monotonically_increasing_id().alias("_row"))
    p = spread(p.withColumns({"bx": F.floor(px / size), "by": F.floor(py / size)}), rows, "bx", "by")
    near = p.join(at, ["bx", "by"]).where(px.between(F.col("w"), F.col("e")) & py.between(F.col("s"), F.col("n")))
    near = spread(near.select("_point", "_row", "poly", _band(py).alias("band")), rows, "poly", "band")
    dealt = edges.where("y1 <> y2").select("poly", "x1", "y1", "x2", "y2").join(shapes, "poly")
    dealt = dealt.withColumn("band", F.explode(F.sequence(_band(_low("y1", "y2")), _band(_high("y1", "y2"))))).select("poly", "band", "x1", "y1", "x2", "y2")
    spans = (F.col("y1") > py) != (F.col("y2") > py)
    hit = near.join(dealt, ["poly", "band"]).where(spans & (px < crossing(py)))
    return hit.groupBy("poly", "band", "_row", "_point").agg(F.count(F.lit(1)).alias("crossings")).where("crossings % 2 = 1").select("_point.*", "poly")


def exactly_one(hits: DataFrame, keys: list[str]) -> DataFrame:
    return hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.min("poly").alias("poly")).where("k = 1").drop("k")


# ---- boxes and segments --------------------------------------------------------------------------------------


def crossed(segments: DataFrame, size: float) -> DataFrame:
    """segments with (bx, by), once for each bucket that they touch, give or take rounding."""
    rows = segments.withColumn("by", _buckets(_low("y1", "y2") / size - _SLACK, _high("y1", "y2") / size + _SLACK))
    level = F.col("y1") == F.col("y2")
    at = lambda y: F.when(level, None).otherwise(crossing(y))
    bottom = at(F.greatest(_low("y1", "y2"), F.col("by") * size))
    top = at(F.least(_high("y1", "y2"), (F.col("by") + 1) * size))
    # within the row and within the segment; a level one is in the row whole
    low = F.greatest(_low("x1", "x2"), F.coalesce(F.least(bottom, top), _low("x1", "x2")))
    high = F.least(_high("x1", "x2"), F.coalesce(F.greatest(bottom, top), _high("x1", "x2")))
    rows = rows.withColumns({"_low": F.least(low, high) / size - _SLACK, "_high": F.greatest(low, high) / size + _SLACK})
    return rows.withColumn("bx", _buckets(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def meets() -> Column:
    """A segment has a point in a closed box (w, s, e, n): their extents meet, and not all corners are on one side."""
    side = lambda x, y: (F.col("x2") - F.col("x1")) * (F.col(y) - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col(x) - F.col("x1"))
    corners = [side(x, y) for x in ("w", "e") for y in ("s", "n")]
    near = (_low("x1", "x2") <= F.col("e")) & (_high("x1", "x2") >= F.col("w")) & (_low("y1", "y2") <= F.col("n")) & (_high("y1", "y2") >= F.col("s"))
    return near & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)


def touching(boxes: DataFrame, segments: DataFrame, key: str, size: float) -> DataFrame:
    """boxes (w, s, e, n and own columns) with each shape (key) of which a segment meets them; the bucket's size should be
    near a box's."""
    b = boxes.select(F.struct(*boxes.columns).alias("_box"), "w", "s", "e", "n").withColumn("bx", _buckets(F.col("w") / size, F.col("e") / size)).withColumn("by", _buckets(F.col("s") / size, F.col("n") / size))
    near = b.join(crossed(segments.select(key, "x1", "y1", "x2", "y2"), size), ["bx", "by"]).where(meets())
    return near.select("_box", key).distinct().select("_box.*", key)


def meeting(boxes: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """boxes with each polygon that they have a point in common with: an edge meets them, or they lie inside it whole."""
    corner = boxes.withColumns({"px": F.col("w"), "py": F.col("s")})
    return touching(boxes, edges, "poly", size).union(inside(corner, edges, size).select(*boxes.columns, "poly")).distinct()


_BOX = ["w", "s", "e", "n"]


def owned(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """hits with the prefecture (pref) of their polygon."""
    return hits.join(edges.select("poly", "pref").distinct(), "poly")


def meeting_own(cells: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """cells (own columns, pref and w, s, e, n) with each polygon of their prefecture that their square meets."""
    return cells.join(owned(meeting(cells.select(*_BOX).distinct(), edges, size), edges), [*_BOX, "pref"])


def near_lines(tiles: DataFrame, segments: DataFrame, size: float) -> DataFrame:
    """(tile, line) of lines that come within pad of a tile (tile, w, s, e, n, pad), by its padded box."""
    grown = tiles.select("tile", *((F.col(c) + d * F.col("pad")).alias(c) for c, d in (("w", -1), ("s", -1), ("e", 1), ("n", 1))))
    return touching(grown, segments, "line", size).select("tile", "line")


def components(cells: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """cells (own columns, pref and w, s, e, n) with poly and how: the polygon of the cell's prefecture that has its centre,
    else the only one that its square meets (coast); several (ambiguous) or none leave poly null."""
    keys = [c for c in cells.columns if c not in _BOX]
    places = cells.select(*_BOX).distinct()
    centre = places.withColumns({"px": (F.col("w") + F.col("e")) / 2, "py": (F.col("s") + F.col("n")) / 2})
    told = lambda hits, how: owned(hits.select(*_BOX, "poly"), edges).select(*_BOX, "pref", "poly", F.lit(how).alias("how"))
    hits = told(inside(centre, edges, size), "centre").unionByName(told(meeting(places, edges, size), "square"))
    of = lambda how: F.when(F.col("how") == how, F.col("poly"))
    best = hits.groupBy(*_BOX, "pref").agg(F.min(of("centre")).alias("_centre"), F.min(of("square")).alias("_square"), F.count(of("square")).alias("_k"))
    k, found = F.col("_k"), F.col("_centre").isNotNull()
    how = F.when(found, "centre").when(k == 1, "coast").when(k > 1, "ambiguous").otherwise("none")
    return cells.join(best, [*_BOX, "pref"], "left").select(*keys, F.coalesce("_centre", F.when(k == 1, F.col("_square"))).alias("poly"), how.alias("how"))


# ---- areas ---------------------------------------------------------------------------------------------------


def ring_areas(edges: DataFrame, *keys: str) -> DataFrame:
    """(poly, keys, km2) on the ellipsoid, of degrees: the signed sum over each ring's edges, which are straight where areas
    are true; rings but the first (ring 0) are holes."""
    phi = lambda y: zone(F.radians(F.col(y)))
    under = F.radians((F.col("x1") + F.col("x2")) / 2) * (phi("y2") - phi("y1"))
    rings = edges.groupBy("poly", *keys, "ring").agg(F.abs(F.sum(under)).alias("a"))
    scale = AXIS * AXIS * (1 - E2) / 1e6
    return rings.groupBy("poly", *keys).agg((F.sum(F.when(F.col("ring") == 0, F.col("a")).otherwise(-F.col("a"))) * scale).alias("km2"))


def planar_areas(edges: DataFrame, *keys: str) -> DataFrame:
    """(poly, keys, area) in the plane of the coordinates, holes subtracted."""
    rings = edges.groupBy("poly", *keys, "ring").agg((F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2).alias("a"))
    return rings.groupBy("poly", *keys).agg(F.sum(F.when(F.col("ring") == 0, F.col("a")).otherwise(-F.col("a"))).alias("area"))


def largest(polygons: DataFrame) -> DataFrame:
    """(pref, poly) of the largest area; of equal ones the smallest id."""
    return polygons.groupBy("pref").agg(F.max_by("poly", F.struct("area", (-F.col("poly")).alias("first"))).alias("poly"))


# ---- pixels --------------------------------------------------------------------------------------------------


def scan_runs(edges: DataFrame, key: str = "poly") -> DataFrame:
    """(key, y, x0, x1): runs of pixels (centres at whole coordinates) inside a polygon, by the even-odd rule."""
    lines = F.explode(F.sequence(F.ceil(_low("y1", "y2")), F.ceil(_high("y1", "y2")) - 1))
    spanned = edges.where(F.ceil(_low("y1", "y2")) < F.ceil(_high("y1", "y2")))
    cuts = spanned.withColumn("y", lines).select(key, "y", crossing(F.col("y")).alias("x"))
    w = Window.partitionBy(key, "y").orderBy("x")
    pairs = cuts.withColumns({"k": F.row_number().over(w), "end": F.lead("x").over(w)}).where("k % 2 = 1")
    return pairs.select(key, "y", F.ceil("x").alias("x0"), (F.ceil("end") - 1).alias("x1")).where("x0 <= x1")


def filled(edges: DataFrame, layers: DataFrame, west: int, south: int, east: int, north: int) -> DataFrame:
    """(x, y, grp, legend) of the pixels in bounds that a polygon covers: of several the last by (grp, legend) of layers
    (poly, grp, legend).  Pixels of a run are made and combined in the same task before they are shuffled."""
    runs = scan_runs(edges).where(F.col("y").between(south, north))
    runs = runs.withColumns({"x0": F.greatest("x0", F.lit(west)), "x1": F.least("x1", F.lit(east))}).where("x0 <= x1")
    pixels = runs.join(layers, "poly").withColumn("x", F.explode(F.sequence("x0", "x1")))
    return last_layer(pixels, ["x", "y"])


def touched(segments: DataFrame) -> DataFrame:
    """(x, y) of all pixels (squares of side 1 around whole coordinates) that a line has a point in."""
    moved = segments.select(*((F.col(c) + 0.5).alias(c) for c in ("x1", "y1", "x2", "y2")))
    box = {"w": F.col("bx").cast("double"), "s": F.col("by").cast("double"), "e": F.col("bx") + 1.0, "n": F.col("by") + 1.0}
    return crossed(moved, 1.0).withColumns(box).where(meets()).select(F.col("bx").alias("x"), F.col("by").alias("y")).distinct()


def last_layer(layers: DataFrame, keys: list[str]) -> DataFrame:
    """Of overlapping layers at a place the last by (grp, legend)."""
    return layers.groupBy(*keys).agg(F.max(F.struct("grp", "legend")).alias("top")).select(*keys, "top.grp", "top.legend")


# ---- rows ----------------------------------------------------------------------------------------------------


def usable(rows: DataFrame, geometry: str) -> DataFrame:
    """Rows whose geometry is neither missing nor empty."""
    return rows.where(F.coalesce(F.col(geometry), F.lit("")) != "")


def in_bounds(edges: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """(poly, w, s, e, n) of the shapes whose box meets a box, edges included."""
    return extents(edges).drop("bands").where((F.col("w") <= east) & (F.col("e") >= west) & (F.col("s") <= north) & (F.col("n") >= south))
