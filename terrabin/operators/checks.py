"""Checks of a dataset: each counts what breaks its rule, so that 0 is right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrabin.functions import strata as K
from terrabin.settings import QuerySettings

from . import compiler, predicate, strata

MAX_PIXELS = 950


def broken(rows: DataFrame, bad: Column) -> DataFrame:
    return rows.agg(F.count_if(bad).alias("broken"))


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables holds, with their multiplicity."""
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count(F.lit(1)).alias("broken"))


def class_parity(pixels: DataFrame, cells: DataFrame) -> DataFrame:
    return parity(pixels.groupBy("cover").agg(F.count(F.lit(1)).alias("n")), cells.groupBy("cover").agg(F.sum("n").alias("n")))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(F.count_if(F.col("c") > 1).alias("broken"))


def detail_equals_overview(cells: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Sums of cells against those of an overview, made from source where that is given."""
    detail = cells.groupBy("pref", "k").agg(F.sum("n").alias("n"))
    overview = strata.coarse(cells if source is None else source, 64, "pref", "k").groupBy("pref", "k").agg(F.sum("n").alias("n"))
    return parity(detail, overview)


def shape(cells: DataFrame) -> DataFrame:
    limit = F.lit(K.ALT_STRIDE)
    return broken(cells, (F.col("k") < 0) | (F.col("k") >= limit) | (F.col("n") <= 0) | (F.col("n") > MAX_PIXELS) | ~F.col("cover").between(0, 15) | ~F.col("veg").between(0, 5))


def shared_cells(cells: DataFrame) -> DataFrame:
    return cells.groupBy("gx", "gy").agg(F.sum("n").alias("n")).agg(F.count_if(F.col("n") > MAX_PIXELS).alias("broken"))


def accepted(cells: DataFrame, rules: DataFrame) -> dict:
    """The strata that rules accept at 100, 250 and 500 m, and at 500 m with elevation."""
    at = {d: predicate.accepted_strata(cells, rules, QuerySettings(distance=d)) for d in (100, 250, 500)}
    return at | {"elevation": predicate.accepted_strata(cells, rules, QuerySettings(model="elevation", distance=500))}


def nested(sets: dict) -> DataFrame:
    """Strata accepted nearer but not farther, or by elevation but not by distance."""
    keys = sets[100].columns
    parts = [sets[100].join(sets[250], keys, "left_anti"), sets[250].join(sets[500], keys, "left_anti"), sets["elevation"].join(sets[500], keys, "left_anti")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(F.count(F.lit(1)).alias("broken"))


def monotone(cells: DataFrame, rules: DataFrame) -> DataFrame:
    return nested(accepted(cells, rules))


def compiled_equals_native(cells: DataFrame, rules: DataFrame, settings: QuerySettings, compiled: DataFrame | None = None) -> DataFrame:
    """Pixels by species and prefecture of the predicate against those of signatures, compiled from the same or given rules."""
    native = predicate.matched(cells, rules, settings).groupBy("species_id", "pref").agg(F.sum("n").alias("pixels"))
    return parity(native, compiler.compiled_areas(cells, rules if compiled is None else compiled, settings).select(native.columns))


def coarse_sums(cells: DataFrame) -> DataFrame:
    """(pref, x, y, n) of cells eight by eight."""
    return strata.coarse(cells, 8, "pref").groupBy("pref", "x", "y").agg(F.sum("n").alias("n"))


def reband(cells: DataFrame) -> DataFrame:
    """100 m bins collapse to the bands kept beside them."""
    fine = strata.banded(cells, 200, 800, "pref").withColumnRenamed("band", "h")
    kept = cells.groupBy("pref", "cover", "h").agg(F.sum("n").alias("n"))
    return parity(fine.select("pref", "cover", "h", "n"), kept)


def candidates_within(cells: DataFrame, rules: DataFrame, settings: QuerySettings) -> DataFrame:
    hit = strata.evaluate(predicate.matched(cells, rules, settings), cells)
    return broken(hit, F.col("matching") > F.col("total"))


def region_parity(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Every cell has exactly one land component of its own prefecture, and none is lost."""
    joined = cells.select("gx", "gy", "pref").distinct().join(regions, ["gx", "gy", "pref"], "left").groupBy("gx", "gy", "pref").agg(F.count("rid").alias("c"), F.max((F.col("rid") != 0) & (F.floor(F.col("rid") / 10) != F.col("pref"))).alias("foreign"))
    return broken(joined, (F.col("c") != 1) | F.col("foreign"))


def increasing(cells: DataFrame) -> DataFrame:
    """Keys of a cell and prefecture that do not rise strictly in the order of their packed rows."""
    one = cells.groupBy("gx", "gy", "pref", "k").agg(F.sum("n").alias("n"))
    last = F.lag("k").over(Window.partitionBy("gx", "gy", "pref").orderBy("k"))
    return broken(one.withColumn("last", last), F.coalesce(F.col("last") >= F.col("k"), F.lit(False)))


def digest(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(n, digest) of a table's columns in any order of rows: what a frozen input must keep."""
    one = lambda c: F.conv(F.substring(F.md5(F.concat(F.lit(f"{c}:"), F.coalesce(F.col(c).cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("bigint")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(sum((one(c) for c in columns), F.lit(0))).alias("digest"))
