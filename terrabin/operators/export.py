"""Rows and lines of the downloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrabin.functions.text import csv_line

#: What an unknown area is called, by status.
UNKNOWN = {"no_environment": "no environment chosen", "no_landcover": "no land cover chosen", "no_scope": "no prefecture", "no_geography": "islands without a range"}


def amount(area: Column, status: Column, unit: str = "km2") -> Column:
    """Three decimals, in hectares times 100; an unknown area as words."""
    words = F.lit("on hold")
    for state, text in UNKNOWN.items():
        words = F.when(status == state, text).otherwise(words)
    return F.when(area.isNull(), words).otherwise(F.format_string("%.3f", area * (100.0 if unit == "ha" else 1.0)))


def csv_lines(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(csv_line(*(F.col(c) for c in columns)).alias("line"))


def audit(rules: DataFrame) -> DataFrame:
    """Rules by evaluation."""
    return rules.groupBy("evaluation").agg(F.count(F.lit(1)).alias("n"))


def packed(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, flat, digest): each group's strata as a sorted flat text and its name by content."""
    pairs = F.array_sort(F.collect_list(F.struct("k", "n")))
    flat = F.array_join(F.transform(pairs, lambda p: F.concat(p["k"].cast("string"), F.lit(":"), p["n"].cast("string"))), ",")
    return cells.groupBy(*keys, "k").agg(F.sum("n").alias("n")).groupBy(*keys).agg(flat.alias("flat")).withColumn("digest", F.substring(F.sha2("flat", 256), 1, 12))


def manifest(packs: DataFrame, *keys: str) -> DataFrame:
    return packs.select(*keys, "digest", F.octet_length("flat").cast("bigint").alias("bytes"))
