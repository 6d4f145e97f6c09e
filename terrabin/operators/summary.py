"""Areas and status of every species in one plan."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrabin.settings import QuerySettings
from terrabin.shipping import stored

from . import predicate, scope, strata


def area_by_pref(cells: DataFrame, rules: DataFrame, settings: QuerySettings, keys: tuple[str, ...] = ()) -> DataFrame:
    """(species_id, pref, keys, pixels, area): cells are first summed to strata by prefecture and row of the grid, on
    which the pixel area depends, so the join with accepted strata meets no cells.  Strata meet one of the species that have
    the same conditions, and its sums are those of the others."""
    dims = [*predicate.DIMS, *(["alt"] if settings.fine else [])]
    small = cells.groupBy("pref", "gy", *keys, *dims).agg(F.sum("n").alias("n")).where("n > 0")  # both uses keep n: one exchange
    own = predicate.selected(rules, settings)
    alike = predicate.alike(own)
    first = own.join(alike.select(F.col("first").alias("species_id")).distinct(), "species_id", "left_semi")
    hit = predicate.matched(small, first, replace(settings, habitats={}))
    area = F.round(F.sum(F.col("n") * strata.area_of_cell(F.col("gy"))), 6)
    sums = hit.groupBy(F.col("species_id").alias("first"), "pref", *keys).agg(F.sum("n").alias("pixels"), area.alias("area"))
    return sums.join(alike, "first").select("species_id", "pref", *keys, "pixels", "area")


def summaries(cells: DataFrame, regions: DataFrame, rules: DataFrame, species: DataFrame, records: DataFrame, aliases: DataFrame, settings: QuerySettings) -> DataFrame:
    """(species_id, status, pixels, total, missing, prefs, records); pixels is null where nothing can be said, 0 where nothing matches.

    Cells are summed once, by prefecture, land component and dimensions; prefectures, components, totals and matches
    all come from that table, and scopes meet totals and matches in one join by component."""
    dims = [*predicate.DIMS, *(["alt"] if settings.fine else [])]
    small = cells.join(regions, ["gx", "gy", "pref"]).groupBy("pref", "region", "rid", *dims).agg(F.sum("n").alias("n"))
    small = stored(small, "strata")  # every part below reads these strata, whose size is then known, and not the cells
    valid = small.select("pref", "region", "rid").distinct()
    areas = stored(scope.record_areas(records), "areas")
    chosen = scope.prefectures(valid.select("pref", "region").distinct(), areas, species, settings)
    where = scope.resolved(chosen, areas, aliases, valid, settings)
    full = where.where("rid is null and label is null").select("species_id", "pref").join(valid.select("pref", "rid"), "pref")
    at = full.select("species_id", "pref", "rid").unionByName(where.where("rid is not null").select("species_id", "pref", "rid")).distinct()
    totals = strata.totals(small, "pref", "rid")
    hit = predicate.matched(small, rules, settings).groupBy("species_id", "pref", "rid").agg(F.sum("n").alias("pixels"))
    scoped = at.join(totals, ["pref", "rid"]).join(hit, ["species_id", "pref", "rid"], "left")
    scoped = scoped.groupBy("species_id").agg(F.sum("total").alias("total"), F.sum("missing").alias("missing"), F.sum("pixels").alias("pixels"))
    counted = chosen.join(areas, ["species_id", "pref"], "left").groupBy("species_id").agg(F.count(F.lit(1)).alias("prefs"), F.sum(F.coalesce("records", F.lit(0))).alias("records"))
    unresolved = where.where("rid is null and label is not null").groupBy("species_id").agg(F.countDistinct("label").alias("unresolved"))
    out = species.select("species_id").join(predicate.any_possible(rules, settings), "species_id", "left")
    for part in (scoped, counted, unresolved):
        out = out.join(part, "species_id", "left")
    mapped = F.coalesce("mapped", F.lit(False))
    empty = [s for s, ids in settings.habitats.items() if not ids]
    state = scope.status({
        "no_environment": F.col("species_id").isin(empty) if empty else F.lit(False),
        "no_landcover": ~mapped & F.coalesce("has_classes", F.lit(False)) & F.lit(bool(settings.excluded)),
        "unmapped": ~mapped,
        "no_scope": F.coalesce("prefs", F.lit(0)) == 0,
        "no_geography": F.col("total").isNull(),
        "partial_geography": F.coalesce("unresolved", F.lit(0)) > 0,
        "partial_environment": F.coalesce("has_unsupported", F.lit(False)),
    })
    known = mapped & (F.coalesce("prefs", F.lit(0)) > 0) & F.col("total").isNotNull()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select("species_id", state.alias("status"), F.when(known, F.coalesce("pixels", F.lit(0))).cast("bigint").alias("pixels"), zero("total"), zero("missing"), zero("prefs"), zero("records"))


def basic(areas: DataFrame, classes: DataFrame, chosen: DataFrame, excluded: tuple[int, ...] = ()) -> DataFrame:
    """The class-only model: areas (pref, cover, pixels), classes (species_id, cover), chosen (species_id, pref)."""
    kept = classes.where(~F.col("cover").isin(list(excluded))) if excluded else classes
    species = chosen.select("species_id").distinct()
    has = classes.groupBy("species_id").agg(F.lit(True).alias("any"))
    left = kept.groupBy("species_id").agg(F.lit(True).alias("some"))
    total = chosen.join(areas, "pref").groupBy("species_id").agg(F.sum("pixels").alias("total"))
    hit = chosen.join(kept.distinct(), "species_id").join(areas, ["pref", "cover"]).groupBy("species_id").agg(F.sum("pixels").alias("pixels"))
    out = species.join(has, "species_id", "left").join(left, "species_id", "left").join(total, "species_id", "left").join(hit, "species_id", "left")
    state = F.when(F.col("some").isNull(), F.when(F.col("any"), F.lit("no_landcover")).otherwise(F.lit("unmapped"))).otherwise(F.lit("evaluated"))
    return out.select("species_id", state.alias("status"), F.when(F.col("some"), F.coalesce("pixels", F.lit(0))).cast("bigint").alias("pixels"), F.coalesce("total", F.lit(0)).cast("bigint").alias("total"))


def effective(rules: DataFrame, settings: QuerySettings) -> DataFrame:
    """(species_id, available, classes, selected, mapped): class masks of selected rules before and after exclusion, and counts."""
    mask = F.col("base_mask" if settings.model == "cover" else "class_mask")
    left = F.lit(~predicate.excluded_mask(settings))
    own = F.when(F.col("supported"), mask).otherwise(0)
    r = predicate.selected(rules, settings).groupBy("species_id")
    return r.agg(F.bit_or(own).cast("bigint").alias("available"), F.bit_or(own.bitwiseAND(left)).cast("bigint").alias("classes"), F.count(F.lit(1)).alias("selected"), F.count_if(own.bitwiseAND(left) != 0).alias("mapped"))


def views(cells: DataFrame, signatures: DataFrame, keys: tuple[str, ...] = ("pref",)) -> DataFrame:
    """Materialised sums by keys, compiled flags, height and class: what area questions read instead of cells."""
    from .compiler import FLAGS, query_cells

    return query_cells(cells, signatures).where("signature > 0").groupBy(*keys, *FLAGS, "h", "cover").agg(F.sum("n").alias("n"))
