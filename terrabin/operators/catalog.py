"""Names, records and taxa: lookups, counts and profiles."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrabin.functions.text import norm

from . import runs
from .scope import normal_records


def resolve_names(labels: DataFrame, catalog: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Adds resolved to labels (key): the crosswalk's name if it maps the key, null if it lists it unmapped, else the
    catalog's own name if it has one."""
    x = crosswalk.select(F.col("source").alias("key"), F.col("status"), F.col("target"), F.lit(True).alias("listed"))
    c = catalog.select(F.col("name").alias("key"), F.lit(True).alias("named")).distinct()
    out = labels.join(x, "key", "left").join(c, "key", "left")
    by_crosswalk = F.when(F.col("status") == "mapped", F.col("target"))
    return out.withColumn("resolved", F.when(F.col("listed"), by_crosswalk).when(F.col("named"), F.col("key"))).drop("status", "target", "listed", "named")


#: Names of the live table's columns in the catalog; fixed values.
NAMES = {"No": "Species_no", "JapaneseName": "Japanese_name", "ScientificName": "Scientific_name", "AuthorYear": "Author_Year", "FamilyJa": "Family_ja", "GenusJa": "Genus_ja"}


def renamed(live: DataFrame) -> DataFrame:
    return live.withColumnsRenamed(NAMES)


def of_rank(taxa: DataFrame, *ranks: str) -> DataFrame:
    """Taxa of some ranks: species and subspecies without any named."""
    return taxa.where(F.col("rank").isin(*(ranks or ("species", "subspecies"))))


def taxon_order(taxa: DataFrame) -> DataFrame:
    """(id, place): the order of ids as numbers, by ranges of a thousand."""
    number = F.col("id").cast("bigint")
    return runs.numbered(taxa.select("id"), [], [number], F.floor(number / 1000), "place")


def record_counts(records: DataFrame, species: DataFrame) -> DataFrame:
    return normal_records(records).join(species.select("species_id"), "species_id", "left_semi").groupBy("species_id", "pref").agg(F.count(F.lit(1)).alias("n"))


def ignored_records(records: DataFrame, species: DataFrame) -> DataFrame:
    """How many records are left out, by reason."""
    named = species.select("species_id", F.lit(True).alias("known"))
    why = F.when(F.col("record_accuracy") != "normal", "accuracy").when(F.col("known").isNull(), "name")
    return records.join(named, "species_id", "left").withColumn("reason", why).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def classes_of(mask: str) -> Column:
    """The union of cover classes over masks, sorted."""
    union = F.bit_or(F.col(mask).cast("bigint"))
    return F.filter(F.sequence(F.lit(1), F.lit(15)), lambda c: F.call_function("shiftright", union, c).bitwiseAND(F.lit(1)) == 1)


def profiles(species: DataFrame, rules: DataFrame, records: DataFrame) -> DataFrame:
    """One row a species: habitats, union of classes, recorded prefectures and records; missing parts are empty."""
    habitat = rules.groupBy("species_id").agg(F.countDistinct("rule_id").alias("environments"), F.count_if("supported").alias("mapped"), classes_of("class_mask").alias("classes"))
    counts = record_counts(records, species).groupBy("species_id").agg(F.count(F.lit(1)).alias("prefs"), F.sum("n").alias("records"))
    out = species.join(habitat, "species_id", "left").join(counts, "species_id", "left")
    none = F.expr("cast(array() as array<int>)")
    return out.select("species_id", "genus", *(F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("environments", "mapped", "prefs", "records")), F.coalesce("classes", none).alias("classes"))


def vocabulary_ids(texts: DataFrame) -> DataFrame:
    """(label, id): H and the rank of each distinct label in code point order."""
    places = runs.numbered(texts.select("label").distinct(), [], ["label"], F.substring("label", 1, 3), "place")
    return places.select("label", F.format_string("H%03d", F.col("place") + 1).alias("id"))


def genus_capacity(species: DataFrame) -> DataFrame:
    """The largest genus and its size; ('', 1) without any."""
    top = species.where("genus <> ''").groupBy("genus").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "genus").limit(1)
    none = species.sparkSession.createDataFrame([("", 1, 1)], "genus string, count long, rank int")
    return top.withColumn("rank", F.lit(0)).unionByName(none).orderBy("rank").limit(1).drop("rank")


def restored(raw: str, species: DataFrame, limit: int) -> DataFrame:
    """(species_id, pos): known ids of a comma list, first occurrences, at most limit."""
    spark = species.sparkSession
    ids = spark.createDataFrame([(raw,)], "raw string").select(F.posexplode(F.split("raw", ",")).alias("pos", "id"))
    known = ids.join(species.select(F.col("species_id").cast("string").alias("id")), "id", "left_semi")
    return known.groupBy("id").agg(F.min("pos").alias("pos")).orderBy("pos").limit(limit).select(F.col("id").cast("bigint").alias("species_id"), F.col("pos").cast("bigint").alias("pos"))


def ranked(areas: DataFrame) -> DataFrame:
    """Comparison order: area descending, unknown last, ties by position; with the bar width against the largest."""
    size = F.coalesce("pixels", F.lit(-1))
    places = runs.numbered(areas.select("species_id", "pixels"), [], [size.desc(), "species_id"], -F.floor(F.log2(size + 2)), "place")
    top = areas.agg(F.max("pixels").alias("top"))  # one row
    out = places.crossJoin(F.broadcast(top))
    return out.select("species_id", "pixels", (F.col("place") + 1).alias("rank"), F.round(F.col("pixels") / F.nullif("top", F.lit(0)), 6).alias("bar"))


def search(species: DataFrame, term: str, columns: tuple[str, ...] = ("name", "genus")) -> DataFrame:
    """Species of which some column (names, families, aliases) holds the term, in any width and case."""
    hay = F.lower(norm(F.concat_ws(" ", *columns)))
    return species.where(F.contains(hay, F.lit(unicodedata.normalize("NFKC", term).lower())))


def page(rows: DataFrame, shown: int, offset: int = 0) -> DataFrame:
    return rows.orderBy("species_id").offset(offset).limit(shown)
