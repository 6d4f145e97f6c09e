"""Map cells and GeoJSON for a viewport."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrabin.functions.grid import cell_box
from terrabin.shipping import stored

from .strata import area_of_cell

#: Most features of one viewport's download; a delivery to files has no limit.
MAX_FEATURES = 50_000


def in_box(cells: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Cells that meet a box, edges included; written over gx and gy so that Parquet statistics prune."""
    return cells.where((F.col("gx") >= (west - 100) * 320 - 1) & (F.col("gx") <= (east - 100) * 320) & (F.col("gy") >= south * 480 - 1) & (F.col("gy") <= north * 480))


def tiles(cells: DataFrame, step: int = 16) -> DataFrame:
    """(tx, ty, cells, bounds, prefs): the index by which tiles are pruned."""
    t = lambda c: F.floor(F.col(c) / step).cast("bigint")
    return cells.groupBy(t("gx").alias("tx"), t("gy").alias("ty")).agg(F.count(F.lit(1)).alias("cells"), F.min("gx").alias("west"), F.min("gy").alias("south"), F.max("gx").alias("east"), F.max("gy").alias("north"), F.array_sort(F.collect_set("pref")).alias("prefs"))


def pruned(index: DataFrame, box: tuple[int, int, int, int], prefs: list[int]) -> DataFrame:
    """Tiles whose bounds meet a box of cells and that hold a wanted prefecture."""
    west, south, east, north = box
    wanted = F.array(*(F.lit(p).cast("bigint") for p in prefs))
    return index.where((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south) & F.arrays_overlap("prefs", wanted))


def merged(evaluated: DataFrame, x: str = "gx", y: str = "gy") -> DataFrame:
    """Cells of several prefectures as one: sums and the sorted distinct prefectures."""
    out = evaluated.groupBy("species_id", F.col(x).alias("x"), F.col(y).alias("y")).agg(F.sum("matching").cast("bigint").alias("matching"), F.sum("total").cast("bigint").alias("total"), F.array_join(F.array_sort(F.collect_set("pref")), ",").alias("prefs"))
    return out.withColumn("shade", shade(F.col("matching") / F.col("total")))


def shade(ratio: Column) -> Column:
    return F.when(ratio < 0.1, 0).when(ratio < 0.3, 1).otherwise(2).cast("bigint")


def features(evaluated: DataFrame, limit: int | None = None) -> DataFrame:
    """(species_id, gx, gy, pref, feature): one GeoJSON feature a matching cell and prefecture, all of them; where a limit is
    given (MAX_FEATURES for a viewport), more are an error."""
    box = cell_box(F.col("gx"), F.col("gy"))
    deg = lambda c: F.format_string("%.6f", box[c])
    point = lambda a, b: F.concat(F.lit("["), deg(a), F.lit(","), deg(b), F.lit("]"))
    ring = F.concat_ws(",", point("west", "south"), point("east", "south"), point("east", "north"), point("west", "north"), point("west", "south"))
    area = F.format_string("%.6f", F.col("matching") * area_of_cell(F.col("gy")))
    text = F.concat(F.lit('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[['), ring, F.lit(']]},"properties":{"species_id":'), F.col("species_id").cast("string"), F.lit(',"prefecture":'), F.col("pref").cast("string"), F.lit(',"candidate_area_km2":'), area, F.lit(',"matching":'), F.col("matching").cast("string"), F.lit("}}"))
    made = evaluated.where("matching > 0").select("species_id", "gx", "gy", "pref", text.alias("feature"))
    if limit is None:
        return made
    # stored, so that counting them does not make them twice; a row beyond the limit is enough to refuse
    made = stored(made.limit(limit + 1), "features")
    if made.count() > limit:
        raise ValueError(f"more than {limit} features")
    return made
