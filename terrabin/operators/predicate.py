"""Habitat predicates over strata: AND within a rule, OR across a species' rules, each stratum counted once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrabin.functions.grid import band_of_bin
from terrabin.settings import QuerySettings

NEAR = (("water", "wb"), ("built", "bb"), ("edge", "eb"), ("rice", "rb"), ("coast", "cb"), ("river", "vb"))
DIMS = ("cover", "h", "veg", "wb", "bb", "eb", "rb", "cb", "vb")


def has(mask: Column | str, bit: Column | str) -> Column:
    """Whether bit is set in an integer mask."""
    m, b = (F.col(x) if isinstance(x, str) else x for x in (mask, bit))
    return F.expr("1") == F.call_function("shiftright", m.cast("int"), b.cast("int")).bitwiseAND(F.lit(1))


def excluded_mask(settings: QuerySettings) -> int:
    return sum(1 << c for c in settings.excluded)


def height_column(settings: QuerySettings) -> Column:
    """The height band that rules see: re-banded from 100 m bins where strata carry them."""
    return band_of_bin(F.col("alt"), settings.low, settings.mountain) if settings.fine else F.col("h")


def selected(rules: DataFrame, settings: QuerySettings) -> DataFrame:
    """Each species' rules that the settings select (no entry: all; an empty list: none)."""
    if not settings.habitats:
        return rules
    chosen = reduce(lambda c, x: c.when(F.col("species_id") == x[0], F.col("rule_id").isin(list(x[1])) if x[1] else F.lit(False)), settings.habitats.items(), F.when(F.lit(False), F.lit(True)))
    return rules.where(chosen.otherwise(True))


def alike(rules: DataFrame) -> DataFrame:
    """(species_id, first): the least species that has the same conditions; rules' names and repeats do not count."""
    fields = ("class_mask", "base_mask", *(f for f, _ in NEAR), "veg", "elev_mask", "elev_required", "supported")
    body = F.sha2(F.to_json(F.array_sort(F.collect_set(F.struct(*fields)))), 256)
    each = rules.groupBy("species_id").agg(body.alias("body"))
    return each.join(each.groupBy("body").agg(F.min("species_id").alias("first")), "body").select("species_id", "first")


def accepts(settings: QuerySettings, height: Column | str = "h") -> Column:
    """Whether a stratum row meets a rule row (columns of both in scope)."""
    h = F.col(height) if isinstance(height, str) else height
    known = (F.col("cover") > 0) & ~has(F.lit(excluded_mask(settings)), "cover")
    level = has("elev_mask", h)
    if settings.model == "cover":
        return F.col("supported") & known & has("base_mask", "cover") & (~F.col("elev_required") | level)
    near = reduce(lambda a, b: a & b, ((~F.col(flag)) | (F.col(bin_) <= settings.limit) for flag, bin_ in NEAR))
    required = F.lit(True) if settings.model == "elevation" or settings.fine else F.col("elev_required")
    return F.col("supported") & known & has("class_mask", "cover") & near & ((F.col("veg_rule") == 0) | (F.col("veg_rule") == F.col("veg"))) & (~required | level)


def by_cover(rules: DataFrame, settings: QuerySettings) -> DataFrame:
    """Each selected rule once for every cover class it accepts: what makes the predicate's join an equality."""
    mask = F.col("base_mask" if settings.model == "cover" else "class_mask").bitwiseAND(F.lit(~excluded_mask(settings)))
    classes = F.filter(F.sequence(F.lit(1), F.lit(15)), lambda c: F.call_function("shiftright", mask, c).bitwiseAND(F.lit(1)) == 1)
    return selected(rules, settings).withColumn("cover", F.explode(classes.cast("array<bigint>"))).withColumnRenamed("veg", "veg_rule")


def accepted_strata(strata: DataFrame, rules: DataFrame, settings: QuerySettings) -> DataFrame:
    """(species_id, dims): distinct strata that some selected rule of a species accepts.

    Rules meet distinct strata (a few thousand at any number of cells) by cover class, with the other conditions as a
    filter on the joined rows; what follows is an equality join on the dimensions, so cells never meet rules directly
    and nothing needs a broadcast, though Spark may choose one by the tables' sizes.
    """
    dims = [*DIMS, *(["alt"] if settings.fine else [])]
    distinct = strata.select(*dims).distinct().withColumn("height", height_column(settings))
    return distinct.join(by_cover(rules, settings), "cover").where(accepts(settings, "height")).select("species_id", *dims).distinct()


def matched(strata: DataFrame, rules: DataFrame, settings: QuerySettings) -> DataFrame:
    """strata rows once for each species that accepts them, with species_id."""
    dims = [*DIMS, *(["alt"] if settings.fine else [])]
    return strata.join(accepted_strata(strata, rules, settings), dims)


def any_possible(rules: DataFrame, settings: QuerySettings) -> DataFrame:
    """(species_id, mapped, no_landcover, empty): whether the predicate accepts any possible key, whatever the data hold."""
    mask = "base_mask" if settings.model == "cover" else "class_mask"
    left = F.col(mask).bitwiseAND(F.lit(~excluded_mask(settings) & 0xFFFE))
    usable = F.col("supported") & (left != 0)
    if settings.model == "elevation" or settings.fine:
        usable &= F.col("elev_mask") != 0
    else:
        usable &= ~F.col("elev_required") | (F.col("elev_mask") != 0)
    return selected(rules, settings).groupBy("species_id").agg(F.bool_or(usable).alias("mapped"), F.bool_or(F.col("supported") & (F.col(mask) != 0)).alias("has_classes"), F.bool_or(~F.col("supported")).alias("has_unsupported"))
