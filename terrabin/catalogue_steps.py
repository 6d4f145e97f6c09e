"""Queries that apply one operator each, where the others of the catalogue use it only within a larger one."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrabin.catalogue import _AREAS, _CODE, _FLAG_BASES, _accept, _b, _labels, query  # noqa: F401
from terrabin.functions import grid, text
from terrabin.functions import strata as K
from terrabin.operators import catalog, compiler, export, mapview, policy, predicate, runs, scope, stencil, strata
from terrabin.settings import QuerySettings
from terrabin.views import base

# ---- projections ---------------------------------------------------------------------------------------------


@query("P3_renamed_taxa", "select s_suppkey as \"Species_no\", s_name as \"Scientific_name\", s_acctbal as \"Author_Year\" from supplier")
def _(spark, sf_dir):
    live = base(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("No"), F.col("s_name").alias("ScientificName"), F.col("s_acctbal").alias("AuthorYear"))
    return catalog.renamed(live)


@query("P10_public_stratum", "select distinct k, cast(k & ~(3072|196608|48) as bigint) as public_k, cast(k & ~(3072|196608) as bigint) as with_height from cell", "cell")
def _(cell):
    return cell.select("k").distinct().select("k", _b(K.public_stratum(F.col("k"), False), "public_k"), _b(K.public_stratum(F.col("k"), True), "with_height"))


@query("P11_compact_base", "select distinct k, cast((k&15)|(((k>>6)&15)<<4)|(((k>>12)&3)<<8)|(((k>>14)&3)<<10)|(((k>>18)&7)<<12) as bigint) as base, cast(k & 15 | (((k>>6)&15)<<6) | (((k>>12)&3)<<12) | (((k>>14)&3)<<14) | (((k>>18)&7)<<18) as bigint) as back from cell", "cell")
def _(cell):
    one = cell.select("k").distinct().withColumn("base", K.compact_base(F.col("k")))
    return one.select("k", _b("base"), _b(K.source_key(F.col("base")), "back"))


@query("P13_height_band", "select x, y, alt, cast(case when alt = 31 then 3 when alt*100 < low then 0 when alt*100 < 900 then 1 else 2 end as bigint) as band from (select x, y, cast(case when height is null then 31 when height >= 3000 then 30 else floor(height/100.0) end as bigint) as alt, 100 + 100 * (cover % 5) as low from px) q", "px")
def _(px):
    at = px.select("x", "y", grid.altitude_bin(F.col("height")).alias("alt"), (100 + 100 * (F.col("cover") % 5)).alias("low"))
    return at.select("x", "y", "alt", grid.band_of_bin(F.col("alt"), F.col("low"), 900).alias("band"))


_ASKED = "select c_custkey, case when c_custkey % 11 = 0 then 'x' when c_custkey % 13 = 0 then 'NaN' else cast(c_custkey % 35 * 100 - 200 + case when c_custkey % 17 = 0 then 50 else 0 end as varchar) end as low, cast(c_custkey % 41 * 100 as varchar) as mountain from customer"


@query("P14_thresholds", f"select c_custkey, cast(case when ok then lo else 200 end as bigint) as low, cast(case when ok then mo else 800 end as bigint) as mountain from (select *, coalesce(lo % 100 = 0 and mo % 100 = 0 and lo between 100 and 2900 and mo <= 3000 and lo < mo, false) as ok from (select *, try_cast(case when low = 'NaN' then null else low end as bigint) as lo, try_cast(mountain as bigint) as mo from ({_ASKED}) a) b) c")
def _(spark, sf_dir):
    key, text = F.col("c_custkey"), lambda c: c.cast("string")
    low = F.when(key % 11 == 0, "x").when(key % 13 == 0, "NaN").otherwise(text(key % 35 * 100 - 200 + F.when(key % 17 == 0, 50).otherwise(0)))
    asked = base(spark, sf_dir, "customer").select("c_custkey", low.alias("low"), text(key % 41 * 100).alias("mountain"))
    return asked.select("c_custkey", grid.valid_thresholds(F.col("low"), F.col("mountain")).alias("t")).select("c_custkey", "t.low", "t.mountain")


@query("P22_shade", "select gx, gy, cast(case when r < 0.1 then 0 when r < 0.3 then 1 else 2 end as bigint) as shade from (select gx, gy, cast(sum(case when cover in (5, 6, 7) then n else 0 end) as double)/sum(n) as r from cell group by gx, gy) q", "cell")
def _(cell):
    hit = F.sum(F.when(F.col("cover").isin(5, 6, 7), F.col("n")).otherwise(0)) / F.sum("n")
    return cell.groupBy("gx", "gy").agg(mapview.shade(hit).alias("shade"))


# ---- filters -------------------------------------------------------------------------------------------------

_RANK = "case s_suppkey % 4 when 0 then 'species' when 1 then 'subspecies' when 2 then 'genus' else 'family' end"


@query("F1_rank_filter", f"select cast(s_suppkey as varchar) as id, {_RANK} as rank from supplier where s_suppkey % 4 in (0, 1)")
def _(spark, sf_dir):
    n = F.col("s_suppkey")
    taxa = base(spark, sf_dir, "supplier").select(n.cast("string").alias("id"), F.when(n % 4 == 0, "species").when(n % 4 == 1, "subspecies").when(n % 4 == 2, "genus").otherwise("family").alias("rank"))
    return catalog.of_rank(taxa)


@query("O1_taxon_order", f"select cast(s_suppkey as varchar) as id, cast(row_number() over (order by cast(cast(s_suppkey as varchar) as bigint)) - 1 as bigint) as place from supplier where s_suppkey % 4 in (0, 1)")
def _(spark, sf_dir):
    taxa = base(spark, sf_dir, "supplier").where("s_suppkey % 4 in (0, 1)").select(F.col("s_suppkey").cast("string").alias("id"))
    return catalog.taxon_order(taxa)


@query("F6_accepts", f"select distinct s.species_id, c.k from (select distinct species_id from rules) s cross join cell c where exists (select 1 from rules q where q.species_id = s.species_id and {_accept(1)})", "cell", "rules")
def _(cell, rules):
    key = K.pack(**{d: F.col(d) for d in K.BITS})
    return predicate.accepted_strata(cell, rules, QuerySettings(distance=250)).select("species_id", _b(key, "k"))


@query("F14_included_rows", "select gx, gy, pref, rid from cell_region where pref in (2, 9) or rid in (51, 72, 113)", "cell_region")
def _(cell_region):
    spark = cell_region.sparkSession
    where = spark.createDataFrame([(2, None), (9, None), (5, 51), (7, 72), (11, 113)], "pref long, rid long")
    return scope.included(cell_region, where)


@query("F15_geometry_and_section", "select l_orderkey, l_linenumber from lineitem where l_shipdate is not null and l_comment_length > 0 and cast(l_linenumber as int) between 1 and 4".replace("l_comment_length > 0", "l_extendedprice is not null and l_quantity > 10"))
def _(spark, sf_dir):
    rows = base(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 10, F.concat(F.lit("POINT("), F.col("l_quantity").cast("string"), F.lit(")"))).otherwise("").alias("wkt"))
    from terrabin.operators import geometry

    return geometry.usable(rows, "wkt").where(F.col("l_linenumber").between(1, 4)).select("l_orderkey", "l_linenumber")


_OUT = "concat_ws('.', o_custkey % 9, o_orderkey % 5, '6x')"


@query("P16_included_classes", f"select o_orderkey, array_to_string(list_sort(list_distinct(list_filter([4, o_custkey % 16, o_orderkey % 16, 4], lambda c: not list_contains(string_split({_OUT}, '.'), cast(c as varchar))))), ',') as classes from orders where o_custkey % 16 > 0 and o_orderkey % 16 > 0")
def _(spark, sf_dir):
    o = base(spark, sf_dir, "orders").where("o_custkey % 16 > 0 and o_orderkey % 16 > 0")
    classes = F.array(F.lit(4).cast("bigint"), (F.col("o_custkey") % 16).cast("bigint"), (F.col("o_orderkey") % 16).cast("bigint"), F.lit(4).cast("bigint"))
    out = text.excluded(F.concat_ws(".", (F.col("o_custkey") % 9).cast("string"), (F.col("o_orderkey") % 5).cast("string"), F.lit("6x")))
    return o.select("o_orderkey", F.array_join(F.array_sort(F.array_except(classes, out)), ",").alias("classes"))


# ---- joins ---------------------------------------------------------------------------------------------------


@query("J5_rules_meet_strata", f"select s.species_id, cast(count(*) as bigint) as strata from (select distinct species_id from rules) s cross join (select distinct cover, h, veg, wb, bb, eb, rb, cb, vb from cell) c where exists (select 1 from rules q where q.species_id = s.species_id and {_accept(2)}) group by 1", "cell", "rules")
def _(cell, rules):
    return predicate.accepted_strata(cell, rules, QuerySettings()).groupBy("species_id").agg(_b(F.count(F.lit(1)), "strata"))


@query("J6_signature_lookup", f"""with {_FLAG_BASES} select k, m100, m250, m500, cover_bits from (select distinct k, cast((k&15)|(((k>>6)&15)<<4)|(((k>>12)&3)<<8)|(((k>>14)&3)<<10)|(((k>>18)&7)<<12) as bigint) as base from cell) c join f using (base)""", "cell", "rules")
def _(cell, rules):
    one = cell.select("k", "h", "cover").distinct()
    return compiler.query_cells(one, compiler.compile_signatures(rules.sparkSession, rules)).select("k", *compiler.FLAGS).distinct()


# ---- aggregates and windows ----------------------------------------------------------------------------------


@query("A2_distinct_habitats", "select species_id, cast(count(distinct rule_id) as bigint) as environments from habitat group by species_id", "habitat")
def _(habitat):
    return habitat.groupBy("species_id").agg(_b(F.countDistinct("rule_id"), "environments"))


@query("A3_union_of_classes", "select species_id, array_to_string(list_filter(generate_series(1, 15), lambda c: (m >> cast(c as int)) & 1 = 1), ',') as classes from (select species_id, bit_or(class_mask) as m from habitat group by species_id) q", "habitat")
def _(habitat):
    return habitat.groupBy("species_id").agg(F.array_join(catalog.classes_of("class_mask"), ",").alias("classes"))


@query("A4_conditional_counts", "select species_id, cast(count(*) filter (where supported) as bigint) as mapped, cast(count(*) filter (where not supported) as bigint) as open, cast(count(*) filter (where coast or river) as bigint) as held from habitat group by species_id", "habitat")
def _(habitat):
    return habitat.groupBy("species_id").agg(_b(F.count_if("supported"), "mapped"), _b(F.count_if(~F.col("supported")), "open"), _b(F.count_if(F.col("coast") | F.col("river")), "held"))


@query("A7_class_counts", "select cover, cast(count(*) as bigint) as n from px group by cover", "px")
def _(px):
    return px.groupBy("cover").agg(_b(F.count(F.lit(1)), "n"))


@query("A8_partial_and_final", "select pref, cover, cast(count(*) as bigint) as n from px group by pref, cover", "px")
def _(px):
    tile = px.groupBy(F.floor(F.col("x") / 16).alias("tx"), F.floor(F.col("y") / 16).alias("ty"), "pref", "cover").agg(F.count(F.lit(1)).alias("n"))
    return tile.groupBy("pref", "cover").agg(_b(F.sum("n"), "n"))


@query("A26_status_counts", "select case when coast or river or (elev_mask & 15) <> 15 then 'publication_hold' when not supported then 'unavailable' when class_mask = 0 then 'excluded_landcover' else 'calculated' end as evaluation, cast(count(*) as bigint) as n from habitat group by 1", "habitat")
def _(habitat):
    return export.audit(policy.metadata(policy.publication_rules(habitat), QuerySettings()))


@query("W3_last_run_value", "select gx, gy, pref, last_value(mark ignore nulls) over (partition by pref order by gy, gx rows unbounded preceding) as last from (select gx, gy, pref, rid, case when (gx + gy) % 5 = 0 then rid end as mark from cell_region) q", "cell_region")
def _(cell_region):
    places = runs.numbered(cell_region, ["pref"], ["gy", "gx"], F.floor(F.col("gy") / runs.WIDTH), "place")
    marks = places.where((F.col("gx") + F.col("gy")) % 5 == 0).select("pref", F.col("place").alias("start"), F.col("rid").alias("last"))
    return runs.attach(cell_region.drop("rid"), marks, ["pref"], ["gy", "gx"], "last").select("gx", "gy", "pref", "last")


@query("W6_first_of_repeated", "select n, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ',') as once from (select n, [label, cast(n % 3 as varchar), label, cast(n % 2 as varchar), cast(n % 3 as varchar)] as w from labels_ja) q", "labels_ja")
def _(labels_ja):
    w = F.array("label", (F.col("n") % 3).cast("string"), "label", (F.col("n") % 2).cast("string"), (F.col("n") % 3).cast("string"))
    return labels_ja.select("n", F.array_join(F.array_distinct(w), ",").alias("once"))


@query("W7_running_nearest", "select x, y, cast((select max(t.y) from px t where t.x = p.x and t.cover = 1 and t.y <= p.y and t.y >= p.y - 5) as bigint) as below from px p", "px")
def _(px):
    return stencil.nearest_before(px, F.col("cover") == 1, 5)


# ---- orders --------------------------------------------------------------------------------------------------


@query("O6_sorted_pairs", "select pref, string_agg(concat(cover, ':', n), ',' order by cover) as pairs from (select pref, cover, cast(sum(n) as bigint) as n from cell group by 1, 2) q group by pref", "cell")
def _(cell):
    flat = export.packed(cell.select("pref", F.col("cover").alias("k"), _b("n")), "pref")
    return flat.select("pref", F.col("flat").alias("pairs"))


@query("O7_limited_distinct", "select * from (values (cast(3 as bigint), cast(0 as bigint)), (1, 1)) as t(species_id, pos)", "species")
def _(species):
    return catalog.restored("3,1,3,2", species, 2)


@query("O8_bar_width", "select species_id, round(cast(s as double)/max(s) over (), 6) as bar from (select species_id, cast(count(*) as bigint) as s from records group by species_id) q", "records")
def _(records):
    areas = records.groupBy("species_id").agg(_b(F.count(F.lit(1)), "pixels"))
    return catalog.ranked(areas).select("species_id", "bar")


# ---- policy --------------------------------------------------------------------------------------------------

_FLAG = lambda k: f"(s_suppkey // {1 << k}) % 2 = 1"


@query("G2_profiles", f"""select s_suppkey, elevation is not null as valid, elevation, case when elevation is not null then elevation and edition = 'local-preview' end as preview from (
  select s_suppkey, edition, case when edition = 'public' and not {_FLAG(0)} and not {_FLAG(1)} then false when edition = 'local-preview' and {_FLAG(3)} and {_FLAG(0)} and {_FLAG(1)} then true
    when edition = 'public-elevation' and {_FLAG(0)} and not {_FLAG(1)} and {_FLAG(2)} then true end as elevation
  from (select s_suppkey, ['public', 'public-elevation', 'local-preview'][s_suppkey % 3 + 1] as edition from supplier) a) b""")  # fmt: skip
def _(spark, sf_dir):
    key = F.col("s_suppkey")
    flags = [F.floor(key / (1 << k)) % 2 == 1 for k in range(4)]
    edition = F.when(key % 3 == 0, "public").when(key % 3 == 1, "public-elevation").otherwise("local-preview")
    told = base(spark, sf_dir, "supplier").select("s_suppkey", policy.profile(edition, *flags).alias("p"))
    return told.select("s_suppkey", F.col("p").isNotNull().alias("valid"), "p.elevation", "p.preview")


@query("G3_approvals", "select s_suppkey, s_suppkey % 4 <> 0 and s_suppkey % 5 <> 0 and s_suppkey % 7 <> 0 and s_suppkey % 11 <> 0 as valid from supplier")
def _(spark, sf_dir):
    """Approvals of suppliers, of which some are open, undated, without a receipt, or not named in the attribution."""
    key, number = F.col("s_suppkey"), F.concat(F.lit("R "), F.col("s_name"))
    status, day = F.when(key % 4 == 0, "open").otherwise("approved"), F.when(key % 5 == 0, "soon").otherwise("2026-01-02")
    receipt = F.when(key % 7 == 0, "zz").otherwise(F.sha2(F.col("s_name").cast("binary"), 256))
    attribution = F.when(key % 11 == 0, "none").otherwise(F.concat(F.lit("map "), number))
    return base(spark, sf_dir, "supplier").select("s_suppkey", policy.approved(status, number, day, receipt, attribution).alias("valid"))


@query("W2_valid_and_broken_runs", "select part, min(start) <> 0 or count(*) <> count(distinct start) as broken from (select o_custkey as part, o_orderkey % 7 * (o_custkey % 3) as start from orders) q group by part")
def _(spark, sf_dir):
    given = base(spark, sf_dir, "orders").select(F.col("o_custkey").alias("part"), (F.col("o_orderkey") % 7 * (F.col("o_custkey") % 3)).alias("start"))
    bad = runs.invalid(given, ["part"]).withColumn("broken", F.lit(True))
    return given.select("part").distinct().join(bad, "part", "left").select("part", F.coalesce("broken", F.lit(False)).alias("broken"))


@query("A6_strata_of_few_dimensions", "select pref, cover, h, cast(count(*) as bigint) as n from px join (select x as x2, y as y2, case when height is null then 3 when height < 200 then 0 when height < 800 then 1 else 2 end as h from px) q on x = x2 and y = y2 group by 1, 2, 3", "px")
def _(px):
    return strata.cells_of_pixels(px).groupBy("pref", "cover", "h").agg(_b(F.sum("n"), "n"))
