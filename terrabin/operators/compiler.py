"""Predicates compiled to signatures: what each of 24,576 compact bases accepts, as bits a habitat."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrabin.functions import strata as K
from terrabin.functions.grid import band_of_bin
from terrabin.settings import QuerySettings

from .predicate import excluded_mask, has, selected

FLAGS = ("m100", "m250", "m500", "cover_bits")


def habitats(rules: DataFrame) -> DataFrame:
    """Supported rules with their bit, by rule_id; at most 30."""
    one = rules.where("supported").dropDuplicates(["rule_id"])
    bit = F.row_number().over(Window.orderBy("rule_id")) - 1
    return one.withColumn("bit", F.when(bit < 30, bit).otherwise(F.raise_error(F.lit("more than 30 habitats"))))


def bases(spark: SparkSession) -> DataFrame:
    """All compact bases with their dimensions."""
    b = spark.range(K.BASES).withColumnRenamed("id", "base")
    dims = K.unpack(K.source_key(F.col("base")))
    return b.select("base", *(dims[d].alias(d) for d in ("bb", "wb", "cover", "eb", "rb", "veg")))


def compile_signatures(spark: SparkSession, rules: DataFrame) -> DataFrame:
    """(base, signature, flags): one row a base; signature 0 accepts nothing.  The habitats, at most 30, come as one array
    beside every base, so that the flags are computed without a shuffle."""
    fields = ("class_mask", "base_mask", "water", "built", "edge", "rice", "coast", "river", F.col("veg").alias("veg_rule"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit")).alias("one"))
    all_ = habitats(rules).agg(F.collect_list(F.struct(*fields)).alias("habitats"))  # one row
    at = lambda mask, bit: F.call_function("shiftright", mask.cast("int"), bit.cast("int")).bitwiseAND(F.lit(1)) == 1

    def near(limit: int):
        def test(r: Column) -> Column:
            usable = at(r["class_mask"], F.col("cover")) & ~r["coast"] & ~r["river"] & ((r["veg_rule"] == 0) | (r["veg_rule"] == F.col("veg")))
            return usable & reduce(lambda a, b: a & b, (~r[f] | (F.col(d) <= limit) for f, d in (("water", "wb"), ("built", "bb"), ("edge", "eb"), ("rice", "rb"))))

        return test

    def bits(test) -> Column:
        return F.aggregate("habitats", F.lit(0).cast("bigint"), lambda sum_, r: sum_ + F.when(test(r), r["one"]).otherwise(0))

    tests = (*(near(d) for d in range(3)), lambda r: at(r["base_mask"], F.col("cover")))
    flags = bases(spark).crossJoin(F.broadcast(all_)).select("base", *(bits(t).alias(n) for t, n in zip(tests, FLAGS, strict=True)))
    nothing = reduce(lambda a, b: a & b, (F.col(f) == 0 for f in FLAGS))
    ids = flags.where(~nothing).select(*FLAGS).distinct().withColumn("signature", F.row_number().over(Window.orderBy(*FLAGS)).cast("bigint"))  # 24,576 rows at most
    return flags.join(F.broadcast(ids), list(FLAGS), "left").select("base", F.coalesce("signature", F.lit(0)).alias("signature"), *FLAGS)


def query_cells(cells: DataFrame, signatures: DataFrame, fine: bool = False) -> DataFrame:
    """cells with their signature and query key qk: an equality join on the compact base."""
    sig = F.broadcast(signatures)  # 24,576 rows at most
    elevation = F.col("alt") if fine else F.col("h")
    out = cells.withColumn("base", K.compact_base(F.col("k"))).join(sig, "base")
    return out.withColumn("qk", K.query_key(F.col("signature"), elevation, F.col("cover"))).drop("base")


def allowed(rules: DataFrame, settings: QuerySettings, spark: SparkSession) -> DataFrame:
    """(species_id, elevation_bin, bits): habitats that a species selects and that an elevation bin allows."""
    bit = habitats(rules).select("rule_id", "bit")
    r = selected(rules.where("supported"), settings).join(F.broadcast(bit), "rule_id")  # at most 30 habitats
    bins = spark.range(32).withColumnRenamed("id", "elevation_bin")
    band = band_of_bin(F.col("elevation_bin"), settings.low, settings.mountain) if settings.fine else F.col("elevation_bin")
    strict = F.lit(settings.model == "elevation" or (settings.fine and settings.model != "cover")) | F.col("elev_required")
    ok = ~strict | ((band < 4) & has("elev_mask", F.least(band, F.lit(4)).cast("int")))
    return r.crossJoin(F.broadcast(bins)).where(ok).groupBy("species_id", "elevation_bin").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("bit"))).cast("bigint").alias("bits"))


def compiled_areas(cells: DataFrame, rules: DataFrame, settings: QuerySettings, keys: tuple[str, ...] = ("pref",)) -> DataFrame:
    """(species_id, keys, pixels) of the cells that each species' compiled predicate accepts.

    Cells meet the table of bases alone, then are summed by keys, the habitats that accept them and the elevation bin:
    some thousands of rows at any number of cells, and only those meet the species."""
    spark = cells.sparkSession
    flag = "cover_bits" if settings.model == "cover" else FLAGS[settings.limit]
    excluded = F.lit(excluded_mask(settings))
    table = compile_signatures(spark, rules).where(F.col(flag) != 0).select("base", F.col(flag).alias("accepted"))
    at = F.col("alt") if settings.fine else F.col("h")
    kept = cells.where(~has(excluded, "cover") & (F.col("cover") > 0)).select(*keys, K.compact_base(F.col("k")).alias("base"), at.alias("elevation_bin"), "n")
    small = kept.join(F.broadcast(table), "base").groupBy(*keys, "accepted", "elevation_bin").agg(F.sum("n").alias("n"))
    met = small.join(allowed(rules, settings, spark), "elevation_bin").where(F.col("accepted").bitwiseAND(F.col("bits")) != 0)
    return met.groupBy("species_id", *keys).agg(F.sum("n").alias("pixels"))


def rule_groups(rules: DataFrame) -> DataFrame:
    """(species_id, group): species with the same set of usable rules share a group; labels do not count."""
    fields = ["rule_id", "class_mask", "base_mask", "water", "built", "edge", "rice", "coast", "river", "veg", "elev_mask", "elev_required"]
    return rules.where("supported").groupBy("species_id").agg(F.substring(F.sha2(F.to_json(F.array_sort(F.collect_set(F.struct(*fields)))), 256), 1, 12).alias("grp"))
