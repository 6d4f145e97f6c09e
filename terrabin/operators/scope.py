"""Which prefectures and land components a species' question covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrabin.settings import QuerySettings


def normal_records(records: DataFrame) -> DataFrame:
    return records.where(F.col("record_accuracy") == "normal")


def record_areas(records: DataFrame) -> DataFrame:
    """(species_id, pref, mainland, islands, unspecified) from records of normal accuracy."""
    named = ~F.col("island").isin("", "mainland", "unknown")
    return normal_records(records).groupBy("species_id", "pref").agg(
        F.bool_or(F.col("island") == "mainland").alias("mainland"),
        F.array_sort(F.collect_set(F.when(named, F.col("island")))).alias("islands"),
        F.bool_or(F.col("island").isin("", "unknown")).alias("unspecified"),
        F.count(F.lit(1)).alias("records"),
    )


def prefectures(prefs: DataFrame, areas: DataFrame, species: DataFrame, settings: QuerySettings) -> DataFrame:
    """(species_id, pref) by region, prefecture and, in recorded scope, records."""
    p = prefs
    if settings.region != "all":
        p = p.where(F.col("region") == int(settings.region))
    if settings.pref is not None:
        p = p.where(F.col("pref") == settings.pref)
    if settings.scope == "recorded":
        return areas.select("species_id", "pref").join(p.select("pref"), "pref", "left_semi").join(species.select("species_id"), "species_id", "left_semi")
    return species.select("species_id").crossJoin(F.broadcast(p.select("pref")))  # 47 prefectures at most


def resolved(scope: DataFrame, areas: DataFrame, aliases: DataFrame, regions: DataFrame, settings: QuerySettings) -> DataFrame:
    """(species_id, pref, rid, label): rid null is the whole prefecture; a label without rid is unresolved.

    Outside recorded scope, without a record or with an unspecified one, the whole prefecture counts, even if islands
    are listed; otherwise the mainland's and each island's component, if it belongs to the prefecture.
    """
    whole = F.lit(None).cast("bigint")
    if settings.scope != "recorded":
        return scope.select("species_id", "pref", whole.alias("rid"), F.lit(None).cast("string").alias("label"))
    s = scope.join(areas, ["species_id", "pref"], "left").withColumn("full", F.coalesce("unspecified", F.lit(True)))
    full = s.where("full").select("species_id", "pref", whole.alias("rid"), F.lit(None).cast("string").alias("label"))
    parts = F.concat(F.when(F.col("mainland"), F.array(F.lit("mainland"))).otherwise(F.expr("cast(array() as array<string>)")), "islands")
    part = s.where("not full").select("species_id", "pref", F.explode(parts).alias("label"))
    known = aliases.select(F.col("island").alias("label"), "pref", "rid")
    mainland = regions.select(F.lit("mainland").alias("label"), "pref", (F.col("pref") * 10 + 1).alias("rid"))
    valid = regions.select("pref", "rid")
    names = known.unionByName(mainland).distinct().join(valid.distinct(), ["pref", "rid"], "left_semi")
    return full.unionByName(part.join(names, ["label", "pref"], "left").select("species_id", "pref", "rid", "label"))


def in_scope(rows: DataFrame, scope: DataFrame) -> DataFrame:
    """rows (with pref and rid, and species_id if theirs differ) that lie in the scope: whole prefectures, then components."""
    keys = ["species_id", "pref"] if "species_id" in rows.columns else ["pref"]
    full = scope.where("rid is null and label is null").select("species_id", "pref")
    part = scope.where("rid is not null").select("species_id", "pref", "rid").distinct()
    return rows.join(full, keys).unionByName(rows.join(part, [*keys, "rid"]))


def included(rows: DataFrame, scope: DataFrame) -> DataFrame:
    """rows (with pref and rid) of a scope (pref, rid): of whole prefectures (rid null) or of named components, each once."""
    whole = scope.where("rid is null").select("pref", F.lit(True).alias("_whole")).distinct()
    part = scope.where("rid is not null").select("pref", "rid", F.lit(True).alias("_part")).distinct()
    met = rows.join(whole, "pref", "left").join(part, ["pref", "rid"], "left")
    return met.where(F.coalesce("_whole", "_part")).select(rows.columns)


def status(c: dict[str, Column]) -> Column:
    """The fixed precedence of result states."""
    order = ("no_environment", "no_landcover", "unmapped", "no_scope", "no_geography", "partial_geography", "partial_environment")
    out = F.lit("evaluated")
    for name in reversed(order):
        out = F.when(c[name], F.lit(name)).otherwise(out)
    return out
