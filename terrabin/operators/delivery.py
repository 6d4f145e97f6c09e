"""Materialised views of rule groups, by scope and partition, refreshed by input stamp.

Species with the same usable rules share a group.  Cells are summed once to the dimensions that compiled predicates read,
meet the groups' signatures of the bases that occur (a join on the base), and are expanded to three views: map (coarse cells), summary (prefectures) and regions (land components), written by view, group and prefecture.
The other views are sums of those that were written: national (a group), recorded (a species in its recorded scope, summed
once for all species of a group that share it; members tells whose it is), and totals (a prefecture or component, whatever
the rules); partition is the map of one prefecture.  Tasks have a bounded number of facts, and folders several files.

Every written row carries the stamp of its inputs: the group's rules and the prefecture's cells.  A refresh computes the
stamps anew, compares them with the table of stamps, and writes the partitions whose stamp has changed, alone; readers take
rows of current stamps, so what a crash or a removed group leaves is not read.  The table of stamps is written last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrabin.functions import strata as K
from terrabin.shipping import TASK_ROWS, dealt, spread, stored

from .compiler import FLAGS, rule_groups

SIGNED = [*FLAGS, "h", "cover"]
_NEAR = (("water", "wb"), ("built", "bb"), ("edge", "eb"), ("rice", "rb"))
EXPANDED = ("map", "summary", "regions")
#: Prefectures' folders that hold most rows of a view, more or less.
FOLDERS = 25
#: Sums that a scope has, more or less.
ROWS_A_SCOPE = 1000
STAMPS = "view string, grp string, pref bigint, stamp string"


def facts(cells: DataFrame, step: int, size: int = 0) -> DataFrame:
    """Cells (gx, gy, pref, rid, k, dims, n) by coarse corner, prefecture, component and compact stratum; many (size) are
    summed in tasks of bounded rows."""
    corner = lambda c: (F.floor(F.col(c) / step) * step).cast("bigint")
    rows = cells.select("pref", "rid", corner("gx").alias("x"), corner("gy").alias("y"), K.compact_base(F.col("k")).alias("base"), "cover", "h", "n")
    return dealt(rows, size, "pref", "rid", "x", "y").groupBy("pref", "rid", "x", "y", "base", "cover", "h").agg(F.sum("n").cast("bigint").alias("n"))


def group_rules(rules: DataFrame) -> DataFrame:
    """Usable rules of each group with their bit, by rule_id."""
    from pyspark.sql import Window

    one = rule_groups(rules).join(rules.where("supported"), "species_id").dropDuplicates(["grp", "rule_id"]).drop("species_id")
    bit = F.row_number().over(Window.partitionBy("grp").orderBy("rule_id")) - 1
    return one.withColumn("bit", F.when(bit < 30, bit).otherwise(F.raise_error(F.lit("more than 30 habitats in a group"))))


def group_signatures(rules: DataFrame, bases: DataFrame) -> DataFrame:
    """(grp, base, flags) of the bases (base) that a group accepts in some mode: 24,576 bases a group at most."""
    dims = K.unpack(K.source_key(F.col("base")))
    b = bases.select("base", *(dims[d].alias(d) for d in ("bb", "wb", "cover", "eb", "rb", "veg")))
    r = group_rules(rules).withColumnRenamed("veg", "veg_rule")
    both = F.col("class_mask").bitwiseOR(F.col("base_mask"))
    at = lambda mask, c: F.call_function("shiftright", mask.cast("int"), c.cast("int")).bitwiseAND(F.lit(1)) == 1
    r = r.withColumn("cover", F.explode(F.filter(F.sequence(F.lit(1), F.lit(15)), lambda c: at(both, c)).cast("array<bigint>")))
    usable = at(F.col("class_mask"), F.col("cover")) & ~F.col("coast") & ~F.col("river") & ((F.col("veg_rule") == 0) | (F.col("veg_rule") == F.col("veg")))
    near = lambda limit: reduce(lambda a, c: a & c, (~F.col(f) | (F.col(d) <= limit) for f, d in _NEAR))
    tests = (*(usable & near(d) for d in range(3)), at(F.col("base_mask"), F.col("cover")))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))
    met = b.join(r, "cover").groupBy("grp", "base").agg(*(F.bit_or(F.when(t, one).otherwise(0)).cast("bigint").alias(n) for t, n in zip(tests, FLAGS, strict=True)))
    return met.where(reduce(lambda a, c: a | c, (F.col(f) != 0 for f in FLAGS)))


def expanded(rows: DataFrame, signatures: DataFrame) -> DataFrame:
    """(view, grp, pref, rid, x, y, signed, n): map, summary and regions of facts; what a view sums away is 0.  Facts that
    are dealt by pref, x and y become map rows where they are, and only the few sums of the other two are shuffled."""
    met = rows.join(signatures, "base")

    def part(name: str, *keys: str) -> DataFrame:
        out = met.groupBy("grp", "pref", *keys, *SIGNED).agg(F.sum("n").cast("bigint").alias("n"))
        return out.select(F.lit(name).alias("view"), "grp", "pref", *(F.col(c) if c in keys else F.lit(0).cast("bigint").alias(c) for c in ("rid", "x", "y")), *SIGNED, "n")

    return part("map", "rid", "x", "y").unionByName(part("summary")).unionByName(part("regions", "rid").where("rid <> 0"))


def stamps(rows: DataFrame, rules: DataFrame, scopes: DataFrame) -> DataFrame:
    """(view, grp, pref, stamp): of (group, prefecture) for the three expanded views (view pair), of a prefecture (totals),
    of a group over all prefectures (national), and with its species' scopes (recorded)."""
    row = F.xxhash64(*sorted(rows.columns)).cast("decimal(20,0)")
    cells = rows.groupBy("pref").agg(F.sha2(F.concat_ws("|", F.sum(row).cast("string"), F.count(F.lit(1)).cast("string")), 256).alias("cells"))
    groups = rule_groups(rules).select("species_id", "grp")
    pair = groups.select("grp").distinct().crossJoin(F.broadcast(cells))  # 47 prefectures at most
    pair = pair.select(F.lit("pair").alias("view"), "grp", "pref", F.sha2(F.concat("grp", "cells"), 256).alias("stamp"))
    totals = cells.select(F.lit("totals").alias("view"), F.lit("all").alias("grp"), "pref", F.col("cells").alias("stamp"))
    whole = lambda df: F.sha2(F.array_join(F.array_sort(F.collect_list(df)), ","), 256)
    national = pair.groupBy("grp").agg(whole("stamp").alias("stamp"))
    scope = scopes.join(groups, "species_id").groupBy("grp").agg(F.sum(F.xxhash64("species_id", "pref", "rid", "label").cast("decimal(20,0)")).cast("string").alias("scope"))
    recorded = national.join(scope, "grp").select(F.lit("recorded").alias("view"), "grp", F.lit(0).cast("bigint").alias("pref"), F.sha2(F.concat("stamp", "scope"), 256).alias("stamp"))
    return pair.unionByName(totals).unionByName(national.select(F.lit("national").alias("view"), "grp", F.lit(0).cast("bigint").alias("pref"), "stamp")).unionByName(recorded)


class Delivery:
    """The views below a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def stamps(self) -> DataFrame:
        try:
            return self.spark.read.schema(STAMPS).parquet(f"{self.path}/stamps")
        except Exception as e:  # the first refresh finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], STAMPS)

    def view(self, name: str) -> DataFrame:
        """Rows of current stamps; filters on grp and pref prune folders."""
        if name == "recorded":
            return self._current("recorded", "recorded").join(self._current("recorded", "members"), ["grp", "pref", "scope"]).drop("scope")
        return self._current("pair", f"expanded/view={name}") if name in EXPANDED else self._current(name, name)

    def _current(self, kind: str, folder: str) -> DataFrame:
        now = self.stamps().where(F.col("view") == kind).select("grp", "pref", "stamp")
        rows = self.spark.read.parquet(f"{self.path}/{folder}")
        return rows.withColumns({"grp": F.col("grp").cast("string"), "pref": F.col("pref").cast("bigint")}).join(now, ["grp", "pref", "stamp"], "left_semi").drop("stamp")

    def _write(self, rows: DataFrame, name: str, *keys: str, size: int = 0, by: tuple[str, ...] = ()) -> None:
        """Replaces the folders of keys that rows have; of many rows (size), a folder's are dealt to files by further columns."""
        files = F.pmod(F.xxhash64(*by), F.lit(1 + size // (TASK_ROWS * FOLDERS))) if by else F.lit(0)
        placed = spread(rows.withColumn("_file", files), size, *keys, "_file").drop("_file") if size > TASK_ROWS else rows.repartition(*keys)
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{self.path}/{name}")

    def refresh(self, cells: DataFrame, rules: DataFrame, scopes: DataFrame, step: int = 64) -> DataFrame:
        """Brings the views up to date; returns (view, grp, pref, stamp) of what was written.  cells as facts() takes them,
        scopes (species_id, pref, rid, label) with rid and label null for whole prefectures."""
        rows = stored(facts(cells, step, cells.count()), "facts")
        now = stored(stamps(rows, rules, scopes), "stamps")
        changed = stored(now.join(self.stamps(), ["view", "grp", "pref", "stamp"], "left_anti"), "changed")
        if changed.isEmpty():
            return changed
        part = lambda kind: changed.where(F.col("view") == kind).select("grp", "pref", "stamp")
        pair = part("pair")
        size = rows.count()
        hit = rows.join(pair.select("pref").distinct(), "pref", "left_semi")
        signed = group_signatures(rules, hit.select("base").distinct()).join(pair.select("grp").distinct(), "grp", "left_semi")
        met = expanded(dealt(hit, size, "pref", "x", "y"), stored(signed, "signed"))
        self._write(met.join(pair, ["grp", "pref"]), "expanded", "view", "grp", "pref", size=size, by=("x", "y"))
        n = F.col("n")
        sums = [F.sum(n).cast("bigint").alias("total"), F.sum(F.when(F.col("cover") == 0, n).otherwise(0)).cast("bigint").alias("missing"), F.sum(F.when(F.col("h") == 3, n).otherwise(0)).cast("bigint").alias("elevation_missing")]
        totals = rows.groupBy("pref", "rid").agg(*sums).join(part("totals"), "pref")
        self._write(totals.select("grp", "pref", "stamp", "rid", "total", "missing", "elevation_missing"), "totals", "grp", "pref")
        # the rest is summed from what was written, so the stamps of pairs must count as current by now
        now.write.mode("overwrite").parquet(f"{self.path}/stamps_next")
        current = Delivery(self.spark, self.path)
        current.stamps = lambda: self.spark.read.schema(STAMPS).parquet(f"{self.path}/stamps_next")
        national = current.view("summary").join(part("national").drop("pref"), "grp").groupBy("grp", "stamp", *SIGNED).agg(F.sum("n").cast("bigint").alias("n"))
        self._write(national.withColumn("pref", F.lit(0).cast("bigint")), "national", "grp", "pref")
        sums, members, many = current._recorded(rules, scopes, part("recorded").drop("pref"))
        self._write(sums.withColumn("pref", F.lit(0).cast("bigint")), "recorded", "grp", "pref", size=many * ROWS_A_SCOPE, by=("scope",))
        self._write(members.withColumn("pref", F.lit(0).cast("bigint")), "members", "grp", "pref")
        now.write.mode("overwrite").parquet(f"{self.path}/stamps")
        return changed

    def _recorded(self, rules: DataFrame, scopes: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """(grp, stamp, scope, signed, n), sums over the whole prefectures and land components of a scope; (grp, stamp, scope,
        species_id), the species that have it; and the number of scopes.  A scope's name is its content."""
        asked = scopes.where("rid is not null or label is null").join(rule_groups(rules).select("species_id", "grp"), "species_id").join(wanted, "grp")
        sets = asked.groupBy("grp", "stamp", "species_id").agg(F.array_sort(F.collect_set(F.struct("pref", "rid"))).alias("at"))  # a region's components at most
        named = stored(sets.withColumn("scope", F.sha2(F.to_json("at"), 256)), "scopes")
        once = stored(named.groupBy("grp", "stamp", "scope").agg(F.min("at").alias("at")), "once")
        many = once.count()
        parts = spread(once, many * ROWS_A_SCOPE, "scope").select("grp", "stamp", "scope", F.explode("at").alias("at")).select("grp", "stamp", "scope", "at.*")
        met = parts.where("rid is null").drop("rid").join(self.view("summary"), ["grp", "pref"]).select("grp", "stamp", "scope", *SIGNED, "n")
        met = met.unionByName(parts.where("rid is not null").join(self.view("regions"), ["grp", "pref", "rid"]).select("grp", "stamp", "scope", *SIGNED, "n"))
        return met.groupBy("grp", "stamp", "scope", *SIGNED).agg(F.sum("n").cast("bigint").alias("n")), named.drop("at"), many
