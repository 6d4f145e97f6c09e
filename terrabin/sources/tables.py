"""Readers: CSV with a byte order mark, dictionary-encoded and mesh JSON, checked files, HTML text, delivery manifests."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrabin.functions.grid import mesh_xy
from terrabin.functions.text import plain_visible_text, visible_text
from terrabin.shipping import ship


def read_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """All columns as strings; a byte order mark before the first name is dropped."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").option("sep", delimiter).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def decoded(payload: DataFrame, columns: list[str]) -> DataFrame:
    """A dictionary-encoded table of payload (columns, dictionaries map<string, array<string>>, rows array<array<string>>)
    as a plain table; a whole number in a column with a dictionary is looked up.  Repeated columns and rows of another
    width are errors."""
    if len(set(columns)) != len(columns):
        raise ValueError("repeated columns")
    row = payload.select("dictionaries", F.posexplode("rows").alias("pos", "row"))
    wide = F.when(F.size("row") == len(columns), F.col("row")).otherwise(F.raise_error(F.lit("row of another width")))
    row = row.withColumn("row", wide)

    def value(i: int, name: str):
        raw, words = F.get("row", F.lit(i)), F.col("dictionaries").getItem(name)
        return F.when(words.isNotNull() & raw.rlike("^[0-9]+$"), F.get(words, F.expr(f"try_cast(row[{i}] as int)"))).otherwise(raw).alias(name)

    return row.select("pos", *(value(i, c) for i, c in enumerate(columns)))


def read_shapes(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, where: Column | None = None) -> DataFrame:
    """(poly, pref, ring, seq, x1, y1, x2, y2) of newline-delimited GeoJSON polygons.  Features whose box misses box, and those
    that where (over poly and pref) refuses, are dropped before their coordinates are unfolded."""
    schema = "bbox array<double>, properties struct<poly: bigint, pref: bigint>, geometry struct<type: string, coordinates: array<array<array<double>>>>"
    rows = spark.read.schema(schema).json(path).select("properties.poly", "properties.pref", "bbox", F.col("geometry.coordinates").alias("rings"))
    if box is not None:
        w, s, e, n = (F.get("bbox", F.lit(i)) for i in range(4))
        rows = rows.where((w <= box[2]) & (e >= box[0]) & (s <= box[3]) & (n >= box[1]))
    if where is not None:
        rows = rows.where(where)
    ring = rows.select("poly", "pref", F.posexplode("rings").alias("ring", "points"))
    pair = F.arrays_zip(F.expr("slice(points, 1, size(points) - 1)").alias("a"), F.expr("slice(points, 2, size(points) - 1)").alias("b"))
    edge = ring.select("poly", "pref", "ring", F.posexplode(pair).alias("seq", "e"))
    at = lambda end, i: F.get(F.col(f"e.{end}"), F.lit(i))
    return edge.select("poly", "pref", F.col("ring").cast("bigint").alias("ring"), F.col("seq").cast("bigint").alias("seq"), at("a", 0).alias("x1"), at("a", 1).alias("y1"), at("b", 0).alias("x2"), at("b", 1).alias("y2"))


def read_dictionary_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A table a file, or with lines a line, all of the same columns."""
    payload = spark.read.schema("columns array<string>, dictionaries map<string, array<string>>, rows array<array<string>>").option("multiLine", not lines).json(path)
    return decoded(payload, payload.first()["columns"])


def verified(spark: SparkSession, path: str, digests: dict[str, str], limit: int = 32 << 20, inflated: int = 64 << 20) -> DataFrame:
    """(name, text) of gzip or plain UTF-8 files whose sha256 is as declared; other files, files beyond limit bytes, and
    texts beyond inflated bytes are errors.  No more than that is ever inflated."""
    files = spark.read.format("binaryFile").load(path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    known = F.create_map(*(F.lit(x) for kv in digests.items() for x in kv))
    ok = (F.sha2("content", 256) == F.try_element_at(known, F.col("name"))) & (F.col("length") <= limit)
    checked = files.select("name", F.when(ok, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("digest or size differs: "), F.col("name")))).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if data[:2] == b"\x1f\x8b":
                    machine = zlib.decompressobj(wbits=31)
                    data = machine.decompress(data, inflated + 1)
                    if len(data) <= inflated and not machine.eof:
                        raise ValueError(f"not a whole gzip file: {name}")
                if len(data) > inflated:
                    raise ValueError(f"too large when inflated: {name}")
                yield pa.RecordBatch.from_pydict({"name": [name], "text": [data.decode()]})

    ship(spark)
    return checked.mapInArrow(run, "name string, text string")


def html_text(pages: DataFrame, plain: bool = False) -> DataFrame:
    """(page_id, text): visible text, one line a block; plain: by plain_visible_text's rules."""
    return pages.select(F.col("page_id").cast("long"), (plain_visible_text if plain else visible_text)(F.col("html")).alias("text"))


def read_mesh(spark: SparkSession, path: str) -> DataFrame:
    """(code, x, y, pref, counts) of regional mesh files {version, grid, aggregation, cells: [[code, [[pref, counts]]]]}.

    Another version, grid or aggregation, a cell of several prefectures, counts that are not 16 whole numbers from 0
    on, and a code that two rows have are errors."""
    raw = spark.read.schema("version int, grid string, aggregation string, cells array<array<string>>").option("multiLine", True).json(path)
    known = (F.col("version") == 3) & (F.col("grid") == "third_order") & (F.col("aggregation") == "all_source_pixel_centers_by_prefecture")
    checked = raw.select(F.explode(F.when(F.coalesce(known, F.lit(False)), F.col("cells")).otherwise(F.raise_error(F.lit("unknown mesh file")))).alias("cell"))
    parts = F.from_json(F.get("cell", F.lit(1)), "array<array<string>>")
    one = F.when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(F.raise_error(F.lit("a cell of several prefectures")))
    rows = checked.select(F.get("cell", F.lit(0)).alias("code"), one.alias("part"))
    counts = F.from_json(F.get("part", F.lit(1)), "array<bigint>")
    sound = (F.size(counts) == 16) & F.forall(counts, lambda n: F.coalesce(n >= 0, F.lit(False)))
    rows = rows.select("code", F.get("part", F.lit(0)).cast("bigint").alias("pref"), F.when(sound, counts).otherwise(F.raise_error(F.lit("counts are not 16 whole numbers"))).alias("counts"))
    once = rows.groupBy("code").agg(F.count(F.lit(1)).alias("c"), F.min("pref").alias("pref"), F.first("counts").alias("counts"))
    once = once.withColumn("xy", F.when(F.col("c") == 1, mesh_xy(F.col("code"))).otherwise(F.raise_error(F.lit("a mesh in two files"))))
    return once.select("code", "xy.x", "xy.y", "pref", "counts")


def assets(manifests: DataFrame) -> DataFrame:
    """(file, sha256, bytes) of all that delivery manifests name: summary and geography, arrays of prefectures and regions,
    and groups (array of structs of summary, map, and an array index)."""
    own = F.concat(F.array("summary", "geography"), "prefectures", "regions")
    lazy = F.flatten(F.transform("groups", lambda g: F.concat(F.array(g["summary"], g["map"]), g["index"])))
    return manifests.select(F.explode(F.concat(own, lazy)).alias("a")).select("a.*")
