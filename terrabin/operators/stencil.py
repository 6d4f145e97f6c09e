"""Neighbourhood operators on pixel grids: forest edges and bounded distances to a target."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrabin.functions.grid import distance_bin

#: Cover classes of forest and bamboo; fixed values.
FOREST = (6, 7, 8, 9, 11)


def forest_edge(pixels: DataFrame) -> DataFrame:
    """(x, y, edge): forest beside other known cover, or the reverse, in the four directions; class 0 is neither.

    Neighbours come from lag and lead along rows and columns, so pixels are sorted, not joined.
    """
    kind = F.when(F.col("cover").isin(list(FOREST)), 1).when(F.col("cover") > 0, 2)
    p = pixels.select("x", "y", kind.alias("kind"))
    out = F.lit(False)
    for line, along in (("y", "x"), ("x", "y")):
        w = Window.partitionBy(line).orderBy(along)
        for shift in (F.lag, F.lead):
            near = F.abs(shift(along).over(w) - F.col(along)) == 1
            name = f"_{shift.__name__}_{along}"
            p = p.withColumn(name, F.coalesce(near & (F.col("kind") + shift("kind").over(w) == 3), F.lit(False)))
            out = out | F.col(name)
    return p.select("x", "y", out.alias("edge"))


def nearest_before(pixels: DataFrame, target: Column, reach: int, tile: int = 64) -> DataFrame:
    """(x, y, below): the nearest target row at or before a pixel's in its column, within reach; sorted by tiles of rows,
    into which targets within reach are replicated."""
    p = pixels.select("x", "y", F.coalesce(target, F.lit(False)).alias("t"))
    own = F.floor(F.col("y") / tile)
    halo = F.sequence(own.cast("bigint"), F.floor((F.col("y") + reach) / tile).cast("bigint"))
    marks = p.where("t").select("x", "y", F.explode(halo).alias("ty"), F.col("y").alias("at"), F.lit(False).alias("own"))
    rows = p.select("x", "y", own.cast("bigint").alias("ty"), F.lit(None).cast("bigint").alias("at"), F.lit(True).alias("own")).unionByName(marks)
    below = F.max("at").over(Window.partitionBy("x", "ty").orderBy("y").rangeBetween(-reach, 0))
    return rows.withColumn("below", below).where("own").select("x", "y", "below")


def windows(pixels: DataFrame, tile: int, halo: int, fill: dict) -> DataFrame:
    """(tx, ty, x, y, columns of fill): every place of each tile that has pixels, with a halo around it; places outside the
    pixels get the fill values.  Pixels are replicated to the tiles in reach, so that a tile can be worked on alone."""
    tiles = pixels.select(F.floor(F.col("x") / tile).cast("bigint").alias("tx"), F.floor(F.col("y") / tile).cast("bigint").alias("ty")).distinct()
    span = lambda t: F.sequence(F.col(t) * tile - halo, F.col(t) * tile + (tile - 1 + halo))
    places = tiles.withColumn("x", F.explode(span("tx"))).withColumn("y", F.explode(span("ty")))
    reach = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile).cast("bigint"), F.floor((F.col(c) + halo) / tile).cast("bigint"))
    seen = pixels.select("x", "y", *fill).withColumn("tx", F.explode(reach("x"))).withColumn("ty", F.explode(reach("y")))
    met = places.join(seen, ["tx", "ty", "x", "y"], "left")
    return met.select("tx", "ty", "x", "y", *(F.coalesce(c, F.lit(v)).alias(c) for c, v in fill.items()))


def distance_bins(pixels: DataFrame, target: Column, dy: float = 100.0, dx: float = 100.0, tile: int = 64) -> DataFrame:
    """(x, y, bin): the distance bin to the nearest target pixel, exact within 500 m.

    Separable: each column finds its nearest target above and below (running last and first over sorted rows, within
    tiles that hold a halo), then a pixel takes the minimum over the columns within reach.  The second pass aggregates
    target columns onto pixels through an equality join on (x, y), so nothing is compared at large.
    """
    reach_y, reach_x = math.floor(500 / dy), math.floor(500 / dx)
    p = pixels.select("x", "y", F.coalesce(target, F.lit(False)).alias("t"))
    ty = (F.floor(F.col("y") / tile)).cast("bigint")
    halo = F.sequence(F.floor((F.col("y") - reach_y) / tile).cast("bigint"), F.floor((F.col("y") + reach_y) / tile).cast("bigint"))
    marked = p.where("t").select("x", F.col("y").alias("y"), F.explode(halo).alias("ty"), F.col("y").alias("at"), F.lit(False).alias("own"))
    rows = p.select("x", "y", ty.alias("ty"), F.when(F.col("t"), F.col("y")).alias("at"), F.lit(True).alias("own")).unionByName(marked)
    w = Window.partitionBy("x", "ty").orderBy("y")
    below = F.last("at", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    down = Window.partitionBy("x", "ty").orderBy(F.col("y").desc())
    above = F.last("at", ignorenulls=True).over(down.rangeBetween(Window.unboundedPreceding, 0))
    gap = F.least(F.abs(F.col("y") - below), F.abs(F.col("y") - above))
    column = rows.withColumn("gap", gap).where("own").select("x", "y", (F.col("gap") * dy).alias("gap"))
    near = column.where(F.col("gap") <= 500)
    spread = near.select(F.explode(F.sequence(F.col("x") - reach_x, F.col("x") + reach_x)).alias("x"), "y", F.col("x").alias("from"), "gap")
    far = (F.col("x") - F.col("from")) * dx
    best = spread.groupBy("x", "y").agg(F.min(far * far + F.col("gap") * F.col("gap")).alias("d2"))
    return p.join(best, ["x", "y"], "left").select("x", "y", distance_bin(F.sqrt("d2")).alias("bin"))
