"""Pixels to strata counts and their rollups; every one is a partial/final hash aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrabin.functions import grid
from terrabin.functions import strata as K

DIMS = ("cover", "h", "alt", "veg", "wb", "bb", "eb", "rb", "cb", "vb")


def cells_of_pixels(pixels: DataFrame, size: int = 5, x0: int = 12000, y0: int = 15000) -> DataFrame:
    """(gx, gy, pref, region, dims, k, n) of pixels (x, y, pref, region, cover, height, bins)."""
    named = pixels.withColumns({"gx": F.floor(F.col("x") / size) + x0, "gy": F.floor(F.col("y") / size) + y0, "h": grid.height_band(F.col("height")), "alt": grid.altitude_bin(F.col("height"))})
    out = named.groupBy("gx", "gy", "pref", "region", *DIMS).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("k", K.pack(**{d: F.col(d) for d in K.BITS}))


def coarse(cells: DataFrame, step: int, *keys: str) -> DataFrame:
    """Counts by the step-aligned corner and keys."""
    corner = lambda c: (F.floor(F.col(c) / step) * step).cast("bigint")
    return cells.groupBy(corner("gx").alias("x"), corner("gy").alias("y"), *keys).agg(F.sum("n").alias("n"))


def bounds(cells: DataFrame, *keys: str) -> DataFrame:
    return cells.groupBy(*keys).agg(F.min("gx").alias("west"), F.min("gy").alias("south"), F.max(F.col("gx") + 1).alias("east"), F.max(F.col("gy") + 1).alias("north"))


def marginalised(cells: DataFrame, elevation: bool = False, *keys: str) -> DataFrame:
    """Counts by key without coast, river and (unless elevation) height."""
    return cells.groupBy(*keys, K.public_stratum(F.col("k"), elevation).alias("k")).agg(F.sum("n").alias("n"))


def banded(cells: DataFrame, low: int, mountain: int, *keys: str) -> DataFrame:
    """100 m altitude bins collapsed to bands."""
    return cells.groupBy(*keys, "cover", grid.band_of_bin(F.col("alt"), low, mountain).alias("band")).agg(F.sum("n").alias("n"))


def area_of_cell(gy: Column) -> Column:
    """Area of one pixel of a quarter mesh cell, at its centre."""
    return grid.pixel_area_km2((gy + 0.5) / 480.0)


def pref_class_area(cells: DataFrame) -> DataFrame:
    """Area and pixels by prefecture and class, by prefecture (cover null), in one pass over grouping sets."""
    per = cells.groupBy("pref", "cover", "gy").agg(F.sum("n").alias("n"))  # the area depends on gy alone
    return per.groupingSets([["pref", "cover"], ["pref"]], "pref", "cover").agg(F.sum("n").alias("pixels"), F.round(F.sum(F.col("n") * area_of_cell(F.col("gy"))), 6).alias("area"))


def evaluate(matched: DataFrame, cells: DataFrame) -> DataFrame:
    """(species_id, gx, gy, pref, matching, total, ratio, missing) of matched strata against all strata of the cell."""
    at = ["gx", "gy", "pref"]
    total = cells.groupBy(*at).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("cover") == 0, F.col("n")).otherwise(0)).alias("missing"))
    hit = matched.groupBy("species_id", *at).agg(F.sum("n").alias("matching"))
    return hit.join(total, at).withColumn("ratio", F.round(F.col("matching") / F.col("total"), 6))


def totals(cells: DataFrame, *keys: str) -> DataFrame:
    n = F.col("n")
    return cells.groupBy(*keys).agg(F.sum(n).alias("total"), F.sum(F.when(F.col("cover") == 0, n).otherwise(0)).alias("missing"), F.sum(F.when(F.col("h") == 3, n).otherwise(0)).alias("elevation_missing"))
