"""Numbers in an order over all rows, and run-length encoding with its inverse, by ranges of the order.

A range is a value of bucket, an expression that never falls along the order (of the first order column, say a band of
rows of the grid).  Rows are sorted within ranges, each in a task of its own; what crosses ranges (counts, last
values) is one row a range, and only those are sorted by part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrabin.shipping import stored

#: Values of the first order column that share a range.
WIDTH = 64


def numbered(rows: DataFrame, part: list[str], order: list, bucket: Column, name: str) -> DataFrame:
    """rows with their place in the order of their part, from 0."""
    ranged = rows.withColumn("_b", bucket)
    each = ranged.groupBy(*part, "_b").agg(F.count(F.lit(1)).alias("_n"))
    each = each.withColumn("_before", F.sum("_n").over(Window.partitionBy(*part).orderBy("_b")) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy(*part, "_b").orderBy(*order)) - 1
    return ranged.join(each, [*part, "_b"]).withColumn(name, (place + F.col("_before")).cast("bigint")).drop("_b", "_before")


def _band(order: list[str]) -> Column:
    return F.floor(F.col(order[0]) / WIDTH)


def placed(rows: DataFrame, part: list[str], order: list[str], value: str | None = None) -> tuple[DataFrame, DataFrame]:
    """rows with their range (_b), their place in it (_i) and the value before theirs in it (_last), sorted and numbered once
    and stored; and the ranges with what is before them: rows (_before) and the last value (_tail).

    The source is evaluated once; what encodes and attaches runs reads the stored rows, and only ranges cross ranges."""
    w = Window.partitionBy(*part, "_b").orderBy(*order)
    own = F.struct(value) if value else F.lit(None)
    numbered_ = rows.withColumn("_b", _band(order)).withColumn("_i", F.row_number().over(w) - 1).withColumn("_last", F.lag(own).over(w) if value else own)
    base = stored(numbered_, "placed")
    each = base.groupBy(*part, "_b").agg(F.count(F.lit(1)).alias("_n"), *([F.max_by(F.struct(value), "_i").alias("_tail")] if value else []))
    over = Window.partitionBy(*part).orderBy("_b")
    tail = {"_tail": F.lag("_tail").over(over)} if value else {}
    return base, each.withColumns({"_before": F.sum("_n").over(over) - F.col("_n"), **tail}).drop("_n")


def encoded(places: tuple[DataFrame, DataFrame], part: list[str], value: str) -> DataFrame:
    """(part, start, value) of placed() rows: the position where each run of equal values starts, within each part."""
    base, each = places
    rows = base.select(*part, "_b", "_i", "_last", value).join(each, [*part, "_b"]).withColumn("start", (F.col("_i") + F.col("_before")).cast("bigint"))
    last = F.when(F.col("_i") == 0, F.col("_tail")).otherwise(F.col("_last"))
    return rows.where((F.col("start") == 0) | (~F.struct(value).eqNullSafe(last))).select(*part, "start", value)


def attached(places: tuple[DataFrame, DataFrame], runs: DataFrame, part: list[str], value: str) -> DataFrame:
    """placed() rows with the value of the last run that starts at or before them: an ordered merge by ranges, not a range join."""
    base, each = places
    idx = base.drop("_last").join(each.select(*part, "_b", "_before"), [*part, "_b"]).withColumn("_idx", (F.col("_i") + F.col("_before")).cast("bigint")).drop("_before", "_i")
    marks = runs.select(*part, F.col("start").alias("_idx"), F.struct(F.col(value).alias("v")).alias("_mark"))
    marked = stored(idx.join(marks, [*part, "_idx"], "left"), "marked")
    carry = marked.where("_mark is not null").groupBy(*part, "_b").agg(F.max_by("_mark", "_idx").alias("_carry"))
    before = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = each.select(*part, "_b").join(carry, [*part, "_b"], "left").withColumn("_carry", F.last("_carry", ignorenulls=True).over(before))
    own = F.last("_mark", ignorenulls=True).over(Window.partitionBy(*part, "_b").orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0))
    joined = marked.join(carried, [*part, "_b"]).withColumn("_mark", F.coalesce(own, "_carry"))
    return joined.withColumn(value, F.col("_mark.v")).drop("_b", "_idx", "_mark", "_carry")


def encode(rows: DataFrame, part: list[str], order: list[str], value: str) -> DataFrame:
    return encoded(placed(rows, part, order, value), part, value)


def attach(rows: DataFrame, runs: DataFrame, part: list[str], order: list[str], value: str) -> DataFrame:
    return attached(placed(rows, part, order), runs, part, value)


def invalid(runs: DataFrame, part: list[str]) -> DataFrame:
    """Parts whose runs do not start at 0 or repeat a start."""
    bad = (F.min("start") != 0) | (F.count("start") != F.countDistinct("start"))
    return runs.groupBy(*part).agg(bad.alias("bad")).where("bad").drop("bad")
