"""Which table answers a question: the driver decides from settings and a few sizes, Catalyst does the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TILES, MAX_PARTITIONS = 24, 8


def map_source(zoom: float, tiles: int, regions_only: bool) -> str:
    """'coarse' below zoom 11 (unless only land components are shown from 8 on) or for more than 24 tiles."""
    if (zoom < 11 and not (zoom >= 8 and regions_only)) or tiles > MAX_TILES:
        return "coarse"
    return "detail"


def partitions(prefs: list[int]) -> list[int] | None:
    """Up to 8 prefectures are read each by itself, more as a whole."""
    return sorted(set(prefs)) if len(set(prefs)) <= MAX_PARTITIONS else None


def pack_choice(narrow: list[int], full: int) -> str:
    """Aggregates by group, unless together they weigh as much as the whole."""
    return "full" if sum(narrow) >= full else "narrow"


def summary_source(scope: str, region: str, pref: int | None) -> str:
    """A national or recorded aggregate where nothing narrows the question, else sums by prefecture."""
    if region == "all" and pref is None:
        return "national" if scope == "environment" else "recorded"
    return "by_prefecture"


def map_source_of(zoom: str, tiles: str, regions_only: str) -> Column:
    """map_source() of a table of questions."""
    far = (F.col(zoom) < 11) & ~((F.col(zoom) >= 8) & F.col(regions_only))
    return F.when(far | (F.col(tiles) > MAX_TILES), "coarse").otherwise("detail")


def source_of(scope: str, region: str, pref: str, recorded: str) -> Column:
    """summary_source() of a table of questions; a recorded sum must exist for the species."""
    whole = (F.col(region) == "all") & F.col(pref).isNull()
    return F.when(whole & (F.col(scope) == "environment"), "national").when(whole & F.col(recorded), "recorded").otherwise("by_prefecture")


def chosen(wanted: DataFrame, full: DataFrame) -> DataFrame:
    """(grp, plan, bytes): pack_choice() of each group, from the sizes of wanted parts (grp, bytes) and of wholes (grp, bytes)."""
    narrow = wanted.groupBy("grp").agg(F.sum("bytes").alias("narrow"))
    both = narrow.join(full.withColumnRenamed("bytes", "whole"), "grp")
    heavy = F.col("narrow") >= F.col("whole")
    return both.select("grp", F.when(heavy, "full").otherwise("narrow").alias("plan"), F.when(heavy, F.col("whole")).otherwise(F.col("narrow")).alias("bytes"))
