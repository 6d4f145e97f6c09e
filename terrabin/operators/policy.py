"""What an edition may publish of rules and strata, and what it says about each rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from terrabin.functions.strata import public_stratum
from terrabin.settings import PREVIEW, PUBLIC, PUBLIC_ELEVATION, QuerySettings

from .predicate import excluded_mask
from .strata import area_of_cell, marginalised

FULL = 15


def requires_elevation(mask: Column) -> Column:
    """Not all four bands are accepted."""
    return mask.bitwiseAND(F.lit(FULL)) != FULL


def publication_rules(rules: DataFrame, elevation: bool = False) -> DataFrame:
    """Rules with hold (sorted, comma-joined layers); held ones lose their classes and support.  Idempotent."""
    height = requires_elevation(F.col("elev_mask")) & F.lit(not elevation)
    parts = F.array_compact(F.array(F.when(height, "height"), F.when(F.col("coast"), "coast"), F.when(F.col("river"), "river")))
    held = F.size(parts) > 0
    before = F.col("hold") if "hold" in rules.columns else F.lit("")
    out = rules.withColumn("_held", held).withColumn("hold", F.when(held, F.array_join(F.array_sort(parts), ",")).otherwise(before))
    out = out.withColumn("elev_required", F.when(~held & requires_elevation(F.col("elev_mask")) & F.lit(elevation), True).otherwise(F.col("elev_required")))
    for mask in ("class_mask", "base_mask"):
        out = out.withColumn(mask, F.when(F.col("_held"), 0).otherwise(F.col(mask)))
    return out.withColumn("supported", F.col("supported") & ~F.col("_held")).drop("_held")


def published(cells: DataFrame, rules: DataFrame, elevation: bool = False) -> tuple[DataFrame, DataFrame]:
    """Strata and rules of an edition: withheld dimensions are summed away."""
    return marginalised(cells, elevation, "gx", "gy", "pref"), publication_rules(rules, elevation)


def metadata(rules: DataFrame, settings: QuerySettings) -> DataFrame:
    """(species_id, rule_id, classes, distances, vegetation_group, elevation_bands, evaluation) of selected rules, and what
    descriptions leave open (unresolved) or only approximate (limitations), where rules carry that."""
    mask = F.col("base_mask" if settings.model == "cover" else "class_mask").bitwiseAND(F.lit(~excluded_mask(settings)))
    near = F.lit(settings.model != "cover") & F.col("supported")
    metres = lambda flag: F.when(near & F.col(flag), settings.distance).cast("bigint")
    hold = F.col("hold") if "hold" in rules.columns else F.lit("")
    state = F.when(hold != "", "publication_hold").when(~F.col("supported"), "unavailable").when(mask == 0, "excluded_landcover")
    if "proxy" in rules.columns:
        state = state.when(F.col("proxy"), "proxy")
    state = state.otherwise("calculated")
    bands = F.array_join(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda b: F.call_function("shiftright", F.col("elev_mask").cast("int"), b).bitwiseAND(F.lit(1)) == 1), ",")
    open_ = [F.array_join(c, ",").alias(n) for c, n in (("pending", "unresolved"), ("limitations", "limitations")) if c in rules.columns]
    return rules.select("species_id", "rule_id", F.when(F.col("supported"), mask).otherwise(0).cast("bigint").alias("classes"), *(metres(f).alias(f"{f}_m") for f in ("water", "built", "edge", "rice", "coast", "river")), F.when(F.col("supported") & (F.col("veg") != 0), F.col("veg")).cast("bigint").alias("vegetation_group"), bands.alias("elevation_bands"), state.alias("evaluation"), *open_)


def describe(rules: DataFrame, low: int = 200, mountain: int = 800) -> DataFrame:
    """(rule_id, text): conditions joined by ' and '; bands in metres."""
    band = F.when(F.col("elev_mask") % 8 == 7, F.lit(None).cast("string"))
    for bits, words in ((3, f"below {mountain} m"), (6, f"from {low} m"), (1, f"below {low} m"), (2, f"from {low} m below {mountain} m"), (4, f"from {mountain} m"), (5, f"below {low} m or from {mountain} m")):
        band = band.when(F.col("elev_mask") % 8 == bits, words)
    parts = [F.when(F.col(f), f"near {f}") for f in ("water", "built", "edge", "rice", "coast", "river")]
    veg = F.when(F.col("veg") != 0, F.concat(F.lit("vegetation "), F.col("veg").cast("string")))
    return rules.select("species_id", "rule_id", F.concat_ws(" and ", *parts, veg, band).alias("description"))


def profile(edition: Column, dem: Column, local_only: Column, approved: Column, allow_preview: Column) -> Column:
    """(elevation, preview) of what an edition may publish, by column; null where its description does not agree."""
    pair = lambda e, p: F.struct(F.lit(e).alias("elevation"), F.lit(p).alias("preview"))
    plain = (edition == PUBLIC) & ~dem & ~local_only
    preview = (edition == PREVIEW) & allow_preview & dem & local_only
    return F.when(plain, pair(False, False)).when(preview, pair(True, True)).when((edition == PUBLIC_ELEVATION) & dem & ~local_only & approved, pair(True, False))


def approved(status: Column, number: Column, issued_on: Column, receipt: Column, attribution: Column) -> Column:
    """Whether an approval is complete, by column: an attribution must hold its number."""
    known = (status == "approved") & number.rlike(r"^[^<>\r\n]{1,100}$") & (F.trim(number) != "") & issued_on.rlike(r"^\d{4}-\d{2}-\d{2}$") & receipt.rlike("^[a-f0-9]{64}$")
    return F.coalesce(known & attribution.contains(number), F.lit(False))


# ---- a projected edition --------------------------------------------------------------------------------------

OUTPUTS = ("tiles", "overview", "summary", "regions")


def projection(cells: DataFrame, elevation: bool = False, step: int = 64) -> DataFrame:
    """(output, x, y, pref, rid, k, n, km2): an edition's four outputs from one pass over cells (with rid), expanded in one
    shuffle; what an output sums away is null, and regions leave out what no component has (rid 0)."""
    public = cells.groupBy("gx", "gy", "pref", "rid", public_stratum(F.col("k"), elevation).alias("k")).agg(F.sum("n").alias("n"))
    corner = lambda c: (F.floor(F.col(c) / step) * step).cast("bigint")
    rows = public.withColumns({"cx": corner("gx"), "cy": corner("gy"), "km2": F.col("n") * area_of_cell(F.col("gy"))})
    sets = [["gx", "gy", "pref", "k"], ["cx", "cy", "pref", "k"], ["pref", "k"], ["pref", "rid", "k"]]
    output = F.when(F.grouping("gx") == 0, "tiles").when(F.grouping("cx") == 0, "overview").when(F.grouping("rid") == 0, "regions").otherwise("summary")
    out = rows.groupingSets(sets, "gx", "gy", "cx", "cy", "pref", "rid", "k").agg(output.alias("output"), F.sum("n").cast("bigint").alias("n"), F.sum("km2").alias("km2"))
    return out.where("output <> 'regions' or rid <> 0").select("output", F.coalesce("gx", "cx").alias("x"), F.coalesce("gy", "cy").alias("y"), "pref", "rid", "k", "n", "km2")


def disagreeing(rows: DataFrame, unassigned: DataFrame) -> DataFrame:
    """(pref, output, n, expected): outputs whose pixels in a prefecture differ from its tiles'; of regions, from those of its
    tiles without the unassigned (pref, n)."""
    total = rows.groupBy("pref").agg(*(F.sum(F.when(F.col("output") == o, F.col("n")).otherwise(0)).cast("bigint").alias(o) for o in OUTPUTS))
    total = total.join(unassigned.select("pref", F.col("n").alias("_none")), "pref", "left")
    expected = lambda o: (F.col("tiles") - F.coalesce("_none", F.lit(0)) if o == "regions" else F.col("tiles")).cast("bigint")
    each = F.explode(F.array(*(F.struct(F.lit(o).alias("output"), F.col(o).alias("n"), expected(o).alias("expected")) for o in OUTPUTS[1:])))
    return total.select("pref", each.alias("c")).select("pref", "c.*").where("n <> expected")


def project(cells: DataFrame, path: str, elevation: bool = False, step: int = 64) -> dict[str, DataFrame]:
    """Writes the four outputs below path by output and prefecture, and reads them back.  The land that goes in is observed on
    the way, what was written is counted: outputs of other pixels are an error, as an edition must not lose land."""
    land, n = Observation("land"), F.col("n")
    watched = cells.observe(land, F.sum("n").alias("all"), F.sum(F.when(F.col("rid") == 0, n).otherwise(0)).alias("unassigned"))
    rows = projection(watched, elevation, step)
    rows.repartition("output", "pref").write.mode("overwrite").partitionBy("output", "pref").parquet(path)
    back = cells.sparkSession.read.schema(rows.schema).parquet(path)
    written = {r.output: r.n for r in back.groupBy("output").agg(F.sum("n").alias("n")).collect()}
    if written or not cells.isEmpty():
        given = land.get
        expected = {o: given["all"] - (o == "regions") * given["unassigned"] for o in OUTPUTS}
        if any(written.get(o, 0) != expected[o] for o in OUTPUTS):
            raise ValueError(f"outputs differ: {written} of {expected}")
    return {o: back.where(F.col("output") == o) for o in OUTPUTS}
