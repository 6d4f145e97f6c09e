"""Writers: spreadsheet CSV, GeoJSON, content-addressed packs by prefecture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrabin.operators.export import csv_lines, manifest, packed


def write_csv(rows: DataFrame, path: str) -> None:
    """One file a task, in the order of its rows, with quoted fields and CRLF; each starts with the byte order mark and the
    column names.  Nothing is shuffled or collected; an order over all rows is that of the files if rows are sorted."""
    head = F.lit("\ufeff" + ",".join('"' + c.replace('"', '""') + '"' for c in rows.columns) + "\r\n")
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of a task
    lines = csv_lines(rows, *rows.columns).withColumn("first", first)
    lines.select(F.when(F.col("first"), F.concat(head, "line")).otherwise(F.col("line")).alias("value")).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_geojson(features: DataFrame, path: str) -> None:
    """Features as newline-delimited GeoJSON, written in parallel."""
    features.select(F.col("feature").alias("value")).write.mode("overwrite").text(path)


def write_shapes(edges: DataFrame, path: str) -> None:
    """Polygons (poly, pref, ring, seq, x1, y1, x2, y2) as newline-delimited GeoJSON features with their boxes; rings closed."""
    point = F.array("x1", "y1")
    ring = edges.groupBy("poly", "pref", "ring").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", point.alias("at")))), lambda v: v["at"]).alias("points"),
        F.array(F.min("x1"), F.min("y1"), F.max("x1"), F.max("y1")).alias("box"),
    )
    ring = ring.withColumn("points", F.concat("points", F.slice("points", 1, 1)))
    box = F.array(*(f(F.get("box", F.lit(i))) for i, f in enumerate((F.min, F.min, F.max, F.max))))
    shape = ring.groupBy("poly", "pref").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "points"))), lambda v: v["points"]).alias("coordinates"), box.alias("bbox"))
    geometry = F.struct(F.lit("Polygon").alias("type"), "coordinates")
    feature = F.struct(F.lit("Feature").alias("type"), "bbox", F.struct("poly", "pref").alias("properties"), geometry.alias("geometry"))
    write_geojson(shape.select(F.to_json(feature).alias("feature")), path)


def write_packs(cells: DataFrame, path: str) -> DataFrame:
    """Strata partitioned by prefecture, and their manifest."""
    packs = packed(cells, "pref", "gx", "gy")
    packs.write.mode("overwrite").partitionBy("pref").parquet(f"{path}/packs")
    listed = manifest(packs, "pref", "gx", "gy")
    listed.write.mode("overwrite").parquet(f"{path}/manifest")
    return listed


def unpacked(packs: DataFrame) -> DataFrame:
    """Strata (keys of the packs, k, n) of packs."""
    pair = F.split(F.col("pair"), ":")
    rows = packs.withColumn("pair", F.explode(F.split("flat", ","))).drop("flat", "digest")
    return rows.withColumns({"k": F.get(pair, 0).cast("bigint"), "n": F.get(pair, 1).cast("bigint")}).drop("pair")


def read_packs(spark: SparkSession, path: str, prefs: list[int] | None = None) -> DataFrame:
    """Strata of a delivery, of some prefectures alone if they are named: other folders are not read.  Packs that differ from
    their names are errors."""
    packs = spark.read.parquet(f"{path}/packs")
    packs = packs if prefs is None else packs.where(F.col("pref").isin(prefs))
    sound = F.when(F.substring(F.sha2("flat", 256), 1, 12) == F.col("digest"), F.col("flat")).otherwise(F.raise_error(F.lit("a pack differs from its digest")))
    return unpacked(packs.withColumn("flat", sound)).withColumn("pref", F.col("pref").cast("bigint"))


def damaged(packs: DataFrame) -> DataFrame:
    """Packs that differ from their names."""
    return packs.where(F.substring(F.sha2("flat", 256), 1, 12) != F.col("digest"))


def out_of_order(packs: DataFrame) -> DataFrame:
    """Packs in which a key does not rise."""
    keys = F.transform(F.split("flat", ","), lambda p: F.get(F.split(p, ":"), F.lit(0)).cast("bigint"))
    falls = F.exists(F.sequence(F.lit(1), F.size("keys") - 1), lambda i: F.get("keys", i) <= F.get("keys", i - 1))
    return packs.withColumn("keys", keys).where((F.size("keys") > 1) & falls).drop("keys")


def changed(old: DataFrame, new: DataFrame, keys: list[str], free: tuple[str, ...]) -> DataFrame:
    """Rows of new that differ from old in more than the free columns, or that old does not have."""
    kept = [c for c in old.columns if c not in free]
    return new.select(kept).exceptAll(old.select(kept)).unionByName(old.select(kept).exceptAll(new.select(kept)).join(new.select(keys), keys, "left_anti"))


def refreshed(old: DataFrame, new: DataFrame, keys: list[str], free: tuple[str, ...]) -> DataFrame:
    """new in place of old, if only free columns (source, license, approval) differ: else an error, as numbers need a new build."""
    if not changed(old, new, keys, free).isEmpty():
        raise ValueError("numbers or rules changed; build the delivery anew")
    return new
