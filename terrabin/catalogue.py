"""Every query of the strata engine and its SQL; names begin with the operator's id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrabin.functions import grid, text
from terrabin.functions import strata as K
from terrabin.operators import catalog, checks, compiler, export, geometry, labels, mapview, policy, predicate, runs, scope, stencil, strata, summary
from terrabin.settings import QuerySettings
from terrabin.shipping import shared_dir
from terrabin.sources import tables
from terrabin.views import base, sql, view

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, body: str | None = None, *views: str):
    """Registers a query over views and the statement, over the same views, that it must equal."""

    def put(f: Callable) -> Callable:
        _QUERIES[name] = lambda spark, sf_dir: f(*(view(spark, sf_dir, v) for v in views)) if views else f(spark, sf_dir)
        if body is not None:
            _SQL[name] = sql(body, *views)
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


BIG = "bigint"
_b = lambda c, name=None: (F.col(c) if isinstance(c, str) else c).cast(BIG).alias(name or c)

# ---- areas: predicates, scope, status ------------------------------------------------------------------------


def _accept(limit: int = 2, model: str = "distance", h: str = "c.h", excluded: int = 0) -> str:
    known = f"q.supported and c.cover > 0 and (({excluded} >> cast(c.cover as int)) & 1) = 0"
    level = f"((q.elev_mask >> cast({h} as int)) & 1) = 1"
    if model == "cover":
        return f"{known} and ((q.base_mask >> cast(c.cover as int)) & 1) = 1 and (not q.elev_required or {level})"
    near = " and ".join(f"(not q.{f} or c.{d} <= {limit})" for f, d in predicate.NEAR)
    need = level if model == "elevation" else f"(not q.elev_required or {level})"
    return f"{known} and ((q.class_mask >> cast(c.cover as int)) & 1) = 1 and {near} and (q.veg = 0 or q.veg = c.veg) and {need}"


def _match(**how) -> str:
    return f"select s.species_id, c.* from (select distinct species_id from rules) s cross join cell c where exists (select 1 from rules q where q.species_id = s.species_id and {_accept(**how)})"


def _area(lat: str) -> str:
    e = grid.E2**0.5
    zone = lambda phi: f"(sin({phi})/(2*(1-{grid.E2!r}*sin({phi})*sin({phi}))) + atanh({e!r}*sin({phi}))/(2*{e!r}))"
    half = "radians(1/24000.0)"
    return f"(({zone(f'(radians({lat})+{half})')} - {zone(f'(radians({lat})-{half})')}) * (cast({grid.AXIS} as double)*{grid.AXIS}*(1-{grid.E2!r})*radians(1/12000.0)/1e6))"


_CELL_AREA = _area("((gy+0.5)/480.0)")


@query("A15_area_by_species_pref", f"select species_id, pref, cast(sum(n) as bigint) as pixels, round(sum(n*{_CELL_AREA}), 6) as area from ({_match(limit=1)}) m group by species_id, pref", "cell", "rules")
def _(cell, rules):
    return summary.area_by_pref(cell, rules, QuerySettings(distance=250))


for _name, _how, _settings in (
    ("F7_distance_100", dict(limit=0), QuerySettings(distance=100)),
    ("F7_elevation_model", dict(limit=2, model="elevation"), QuerySettings(model="elevation")),
    ("F7_cover_model", dict(model="cover"), QuerySettings(model="cover")),
    ("P16_excluded", dict(limit=2, excluded=(1 << 8) + (1 << 6)), QuerySettings(excluded=(6, 8))),
    ("F8_thresholds", dict(limit=2, model="elevation", h="(case when c.alt = 31 then 3 when c.alt*100 < 500 then 0 when c.alt*100 < 1200 then 1 else 2 end)"), QuerySettings(fine=True, low=500, mountain=1200)),
):

    @query(_name, f"select species_id, pref, cast(sum(n) as bigint) as pixels from ({_match(**_how)}) m group by species_id, pref", "cell", "rules")
    def _(cell, rules, settings=_settings):
        return summary.area_by_pref(cell, rules, settings).select("species_id", "pref", _b("pixels"))


def _status(recorded: bool, excluded: int = 0, region: int | None = None) -> str:
    where = f"where region = {region}" if region is not None else ""
    chosen = "select distinct a.species_id, a.pref from ra a join pf using (pref) join species s on s.species_id = a.species_id" if recorded else "select species_id, pref from species cross join pf"
    full = "select ch.species_id, ch.pref from ch join ra using (species_id, pref) where unspecified" if recorded else "select species_id, pref from ch"
    return f"""with rec as (select * from records where record_accuracy = 'normal'),
ra as (select species_id, pref, bool_or(island = 'mainland') as mainland, bool_or(island = '' or island = 'unknown') as unspecified, count(*) as records from rec group by species_id, pref),
pf as (select distinct pref from cell {where}),
ch as ({chosen}),
fu as ({full}),
ri as (select distinct pref, rid from cell_region),
pa as (select distinct ch.species_id, ch.pref, case when r.island = 'mainland' then m.rid else v.rid end as rid, r.island
  from ch join rec r using (species_id, pref) join ra using (species_id, pref)
  left join (select pref, rid from ri where rid = pref*10+1) m on m.pref = ch.pref
  left join (select a.island, a.pref, a.rid from island_alias a join ri on ri.pref = a.pref and ri.rid = a.rid) v on v.island = r.island and v.pref = ch.pref
  where not ra.unspecified and r.island <> '' and {str(recorded).lower()}),
cr as (select c.*, rid from cell c join cell_region using (gx, gy, pref)),
sc as (select f.species_id, c.* from fu f join cr c on c.pref = f.pref union all select p.species_id, c.* from (select distinct species_id, pref, rid from pa where rid is not null) p join cr c on c.pref = p.pref and c.rid = p.rid),
t as (select species_id, sum(n) as total, sum(case when cover = 0 then n else 0 end) as missing from sc group by species_id),
m as (select c.species_id, sum(n) as pixels from sc c where exists (select 1 from rules q where q.species_id = c.species_id and {_accept(2, excluded=excluded)}) group by c.species_id),
k as (select ch.species_id, count(*) as prefs, sum(coalesce(records, 0)) as records from ch left join ra using (species_id, pref) group by ch.species_id),
u as (select species_id, count(*) as unresolved from pa where rid is null group by species_id),
r as (select species_id, bool_or(supported and (class_mask & {~excluded & 0xFFFE}) <> 0 and (not elev_required or elev_mask <> 0)) as mapped, bool_or(supported and class_mask <> 0) as has_classes, bool_or(not supported) as has_unsupported from rules group by species_id)
select s.species_id, case when not coalesce(mapped, false) and coalesce(has_classes, false) and {excluded} <> 0 then 'no_landcover' when not coalesce(mapped, false) then 'unmapped' when coalesce(prefs, 0) = 0 then 'no_scope'
  when total is null then 'no_geography' when coalesce(unresolved, 0) > 0 then 'partial_geography' when coalesce(has_unsupported, false) then 'partial_environment' else 'evaluated' end as status,
  cast(case when coalesce(mapped, false) and coalesce(prefs, 0) > 0 and total is not null then coalesce(pixels, 0) end as bigint) as pixels,
  cast(coalesce(total, 0) as bigint) as total, cast(coalesce(missing, 0) as bigint) as missing, cast(coalesce(prefs, 0) as bigint) as prefs, cast(coalesce(records, 0) as bigint) as records
from species s left join t using (species_id) left join m using (species_id) left join k using (species_id) left join u using (species_id) left join r using (species_id)"""


for _name, _args, _settings in (
    ("A15_status", (True,), QuerySettings()),
    ("A15_status_environment", (False,), QuerySettings(scope="environment")),
    ("A15_status_excluded", (True, 1 << 5, 2), QuerySettings(excluded=(5,), region="2")),
):

    @query(_name, _status(*_args), "cell", "cell_region", "rules", "species", "records", "island_alias")
    def _(cell, cell_region, rules, species, records, island_alias, settings=_settings):
        return summary.summaries(cell, cell_region, rules, species, records, island_alias, settings)


@query("A13_evaluate_strata", f"""with m as (select species_id, gx, gy, pref, sum(n) as matching from ({_match(limit=2)}) x group by species_id, gx, gy, pref),
t as (select gx, gy, pref, sum(n) as total, sum(case when cover = 0 then n else 0 end) as missing from cell group by gx, gy, pref)
select species_id, gx, gy, pref, cast(matching as bigint) as matching, cast(total as bigint) as total, cast(missing as bigint) as missing, round(cast(matching as double)/total, 6) as ratio from m join t using (gx, gy, pref)""", "cell", "rules")  # fmt: skip
def _(cell, rules):
    return strata.evaluate(predicate.matched(cell, rules, QuerySettings()), cell)


@query("A14_summarize_basic", """with sc as (select distinct species_id, cast(u.c as bigint) as cover from rules cross join (select unnest(generate_series(1, 15)) as c) u where ((class_mask >> cast(u.c as int)) & 1) = 1),
ch as (select distinct r.species_id, r.pref from records r join (select distinct species_id from rules) s using (species_id) where record_accuracy = 'normal'),
a as (select pref, cover, sum(n) as pixels from cell group by pref, cover)
select s.species_id, case when not exists (select 1 from sc where sc.species_id = s.species_id and cover <> 5) then case when exists (select 1 from sc where sc.species_id = s.species_id) then 'no_landcover' else 'unmapped' end else 'evaluated' end as status,
  cast(case when exists (select 1 from sc where sc.species_id = s.species_id and cover <> 5) then (select coalesce(sum(pixels), 0) from ch join sc using (species_id) join a using (pref, cover) where ch.species_id = s.species_id and cover <> 5) end as bigint) as pixels,
  cast((select coalesce(sum(pixels), 0) from ch join a using (pref) where ch.species_id = s.species_id) as bigint) as total
from (select distinct species_id from ch) s""", "cell", "rules", "records")  # fmt: skip
def _(cell, rules, records):
    classes = rules.select("species_id", F.explode(F.sequence(F.lit(1), F.lit(15))).alias("cover"), "class_mask").where(predicate.has("class_mask", "cover")).select("species_id", _b("cover")).distinct()
    chosen = scope.normal_records(records).select("species_id", "pref").distinct().join(rules.select("species_id").distinct(), "species_id", "left_semi")
    return summary.basic(cell.groupBy("pref", "cover").agg(F.sum("n").alias("pixels")), classes, chosen, (5,))


@query("A5_pref_class_area", f"select pref, cover, cast(sum(n) as bigint) as pixels, round(sum(n*{_CELL_AREA}), 6) as area from cell group by grouping sets ((pref, cover), (pref))", "cell")
def _(cell):
    return strata.pref_class_area(cell)


# ---- strata --------------------------------------------------------------------------------------------------


@query("A6_strata", "select gx, gy, pref, region, k, alt, cast(sum(n) as bigint) as n from cell group by gx, gy, pref, region, k, alt", "px", "cell")
def _(px, cell):
    return strata.cells_of_pixels(px).select("gx", "gy", "pref", "region", "k", "alt", _b("n"))


@query("P9_key_roundtrip", "select k, alt, cover, h, veg, wb, bb, eb, rb, cb, vb, cast(k & ~(3072|196608|48) as bigint) as public_k, cast((k&15)|(((k>>6)&15)<<4)|(((k>>12)&3)<<8)|(((k>>14)&3)<<10)|(((k>>18)&7)<<12) as bigint) as base, cast(sum(n) as bigint) as n from cell group by all", "cell")
def _(cell):
    packed = cell.select(K.pack(**{d: F.col(d) for d in [*K.BITS, "alt"]}).alias("kk"), "n")
    dims = K.unpack(F.col("kk"))
    plain = F.col("kk") % K.ALT_STRIDE
    back = packed.select(plain.alias("k"), *(v.cast(BIG).alias(d) for d, v in dims.items()), K.public_stratum(plain).alias("public_k"), K.compact_base(plain).alias("base"), "n")
    return back.groupBy("k", *dims, "public_k", "base").agg(_b(F.sum("n"), "n"))


for _step in (8, 64):

    @query(f"A9_coarse{_step}", f"select cast(floor(gx/{_step}.0)*{_step} as bigint) as x, cast(floor(gy/{_step}.0)*{_step} as bigint) as y, pref, cover, cast(sum(n) as bigint) as n from cell group by 1, 2, 3, 4", "cell")
    def _(cell, step=_step):
        return strata.coarse(cell, step, "pref", "cover")


@query("A10_bounds", "select pref, min(gx) as west, min(gy) as south, max(gx)+1 as east, max(gy)+1 as north from cell group by pref", "cell")
def _(cell):
    return strata.bounds(cell, "pref")


@query("A11_marginalise", "select pref, cast(k & ~(3072|196608|48) as bigint) as k, cast(sum(n) as bigint) as n from cell group by 1, 2", "cell")
def _(cell):
    return strata.marginalised(cell, False, "pref")


@query("A12_reband", "select pref, cover, cast(case when alt = 31 then 3 when alt*100 < 300 then 0 when alt*100 < 1000 then 1 else 2 end as bigint) as band, cast(sum(n) as bigint) as n from cell group by 1, 2, 3", "cell")
def _(cell):
    return strata.banded(cell, 300, 1000, "pref")


@query("A17_query_totals", "select pref, rid, cast(sum(n) as bigint) as total, cast(sum(case when cover = 0 then n else 0 end) as bigint) as missing, cast(sum(case when h = 3 then n else 0 end) as bigint) as elevation_missing from cell join cell_region using (gx, gy, pref) group by pref, rid", "cell", "cell_region")
def _(cell, cell_region):
    return strata.totals(cell.join(cell_region, ["gx", "gy", "pref"]), "pref", "rid")


@query("A21_region_overview", "select cast(floor(gx/64.0)*64 as bigint) as x, cast(floor(gy/64.0)*64 as bigint) as y, pref, rid, cast(sum(n) as bigint) as n from cell join cell_region using (gx, gy, pref) group by 1, 2, 3, 4", "cell", "cell_region")
def _(cell, cell_region):
    return strata.coarse(cell.join(cell_region, ["gx", "gy", "pref"]), 64, "pref", "rid")


# ---- compiled predicates -------------------------------------------------------------------------------------

_BITS = "(select rule_id, max(class_mask) as class_mask, max(base_mask) as base_mask, bool_or(water) as water, bool_or(built) as built, bool_or(edge) as edge, bool_or(rice) as rice, bool_or(coast) as coast, bool_or(river) as river, max(veg) as vr, row_number() over (order by rule_id) - 1 as bit from rules where supported group by rule_id)"


def _flag(limit: int | None) -> str:
    if limit is None:
        return "sum(case when ((base_mask >> cast(cover as int)) & 1) = 1 then cast(1 as bigint) << cast(bit as int) else 0 end)"
    return f"sum(case when ((class_mask >> cast(cover as int)) & 1) = 1 and not coast and not river and (vr = 0 or vr = veg) and (not water or wb <= {limit}) and (not built or bb <= {limit}) and (not edge or eb <= {limit}) and (not rice or rb <= {limit}) then cast(1 as bigint) << cast(bit as int) else 0 end)"


_FLAG_BASES = f"""b as (select cast(i as bigint) as base, i & 3 as bb, (i >> 2) & 3 as wb, (i >> 4) & 15 as cover, (i >> 8) & 3 as eb, (i >> 10) & 3 as rb, (i >> 12) & 7 as veg from (select unnest(generate_series(0, 24575)) as i) g),
f as (select base, {', '.join(f'cast({_flag(d)} as bigint) as {n}' for d, n in zip((0, 1, 2, None), compiler.FLAGS, strict=True))} from b cross join {_BITS} r group by base)"""


@query("C1_signatures", f"""with b as (select cast(i as bigint) as base, i & 3 as bb, (i >> 2) & 3 as wb, (i >> 4) & 15 as cover, (i >> 8) & 3 as eb, (i >> 10) & 3 as rb, (i >> 12) & 7 as veg from (select unnest(generate_series(0, 24575)) as i) g)
select base, {', '.join(f'cast({_flag(d)} as bigint) as {n}' for d, n in zip((0, 1, 2, None), compiler.FLAGS, strict=True))} from b cross join {_BITS.replace('from rules', 'from habitat')} r group by base""", "habitat")  # fmt: skip
def _(habitat):
    return compiler.compile_signatures(habitat.sparkSession, habitat).drop("signature")


@query("A19_compiled_areas", f"select species_id, pref, cast(sum(n) as bigint) as pixels from ({_match(limit=1)}) m group by species_id, pref", "cell", "rules")
def _(cell, rules):
    return compiler.compiled_areas(cell, rules, QuerySettings(distance=250)).select("species_id", "pref", _b("pixels"))


@query("A18_scope_aggregate", "select cover, h, cast(sum(n) as bigint) as n, cast(sum(case when pref in (select pref from records where record_accuracy = 'normal' and species_id = 1) then n else 0 end) as bigint) as recorded from cell group by cover, h", "cell", "records")
def _(cell, records):
    seen = F.broadcast(scope.normal_records(records).where("species_id = 1").select("pref", F.lit(True).alias("seen")).distinct())
    return cell.join(seen, "pref", "left").groupBy("cover", "h").agg(_b(F.sum("n"), "n"), _b(F.sum(F.when(F.col("seen"), F.col("n")).otherwise(0)), "recorded"))


@query("C2_rule_groups", """with s as (select species_id, string_agg(concat_ws('|', rule_id, class_mask, base_mask, water, built, edge, rice, coast, river, veg, elev_mask, elev_required), ';' order by rule_id) as body from habitat where supported group by species_id)
select species_id, min(species_id) over (partition by body) as first from s""", "habitat")  # fmt: skip
def _(habitat):
    from pyspark.sql import Window

    return compiler.rule_groups(habitat).select("species_id", F.min("species_id").over(Window.partitionBy("grp")).alias("first"))


# ---- policy --------------------------------------------------------------------------------------------------

_HELD = "(elev_mask & 15) <> 15"


@query("G1_publication_policy", f"select species_id, rule_id, array_to_string(list_filter([case when coast then 'coast' end, case when (elev_mask & 15) <> 15 then 'height' end, case when river then 'river' end], lambda x: x is not null), ',') as hold, cast(case when {_HELD} or coast or river then 0 else class_mask end as bigint) as class_mask, supported and not ({_HELD}) and not coast and not river as supported from habitat", "habitat")
def _(habitat):
    once = policy.publication_rules(habitat)
    return policy.publication_rules(once).select("species_id", "rule_id", "hold", _b("class_mask"), "supported")


@query("F16_requires_elevation", f"select species_id, rule_id, {_HELD} as required from habitat", "habitat")
def _(habitat):
    return habitat.select("species_id", "rule_id", policy.requires_elevation(F.col("elev_mask")).alias("required"))


@query("P23_habitat_metadata", f"select species_id, rule_id, cast(case when supported then class_mask & ~(1 << 11) else 0 end as bigint) as classes, {', '.join(f'cast(case when supported and {f} then 250 end as bigint) as {f}_m' for f in ('water', 'built', 'edge', 'rice', 'coast', 'river'))}, cast(case when supported and veg <> 0 then veg end as bigint) as vegetation_group, array_to_string(list_filter([0, 1, 2, 3], lambda b: (elev_mask >> cast(b as int)) & 1 = 1), ',') as elevation_bands, case when not supported then 'unavailable' when (class_mask & ~(1 << 11)) = 0 then 'excluded_landcover' else 'calculated' end as evaluation from habitat", "habitat")
def _(habitat):
    return policy.metadata(habitat, QuerySettings(distance=250, excluded=(11,)))


@query("P21_rule_description", f"select species_id, rule_id, concat_ws(' and ', {', '.join(f'case when {f} then {chr(39)}near {f}{chr(39)} end' for f in ('water', 'built', 'edge', 'rice', 'coast', 'river'))}, case when veg <> 0 then concat('vegetation ', cast(veg as varchar)) end, case elev_mask % 8 when 3 then 'below 800 m' when 6 then 'from 200 m' when 1 then 'below 200 m' when 2 then 'from 200 m below 800 m' when 4 then 'from 800 m' when 5 then 'below 200 m or from 800 m' end) as description from habitat", "habitat")
def _(habitat):
    return policy.describe(habitat)


@query("G4_published_strata", "select gx, gy, pref, cast(k & ~(3072|196608) as bigint) as k, cast(sum(n) as bigint) as n from cell group by 1, 2, 3, 4", "cell", "rules")
def _(cell, rules):
    return policy.published(cell, rules, True)[0]


@query("K7_rule_audit", f"select case when {_HELD} or coast or river then 'publication_hold' when not supported then 'unavailable' when class_mask = 0 then 'excluded_landcover' else 'calculated' end as evaluation, cast(count(*) as bigint) as n from habitat group by 1", "habitat")
def _(habitat):
    return export.audit(policy.metadata(policy.publication_rules(habitat), QuerySettings()))


# ---- names, records, taxa ------------------------------------------------------------------------------------

_CROSS = "(select name as source, case when species_id % 3 = 0 then 'unmapped' else 'mapped' end as status, concat('taxon ', cast(species_id as varchar(10))) as target from species where species_id % 2 = 0)"


def _labels(species: DataFrame) -> DataFrame:
    return species.select("species_id", F.when(F.col("species_id") % 7 == 0, F.concat("name", F.lit(" x"))).otherwise(F.col("name")).alias("key"))


def _crosswalk(species: DataFrame) -> DataFrame:
    s = species.where("species_id % 2 = 0")
    return s.select(F.col("name").alias("source"), F.when(F.col("species_id") % 3 == 0, "unmapped").otherwise("mapped").alias("status"), F.concat(F.lit("taxon "), F.col("species_id").cast("string")).alias("target"))


_RESOLVED = f"select l.species_id, l.key, case when x.source is not null then case when x.status = 'mapped' then x.target end when n.name is not null then l.key end as resolved from (select species_id, case when species_id % 7 = 0 then concat(name, ' x') else name end as key from species) l left join {_CROSS} x on x.source = l.key left join species n on n.name = l.key"


@query("J1_resolve_name", _RESOLVED, "species")
def _(species):
    return catalog.resolve_names(_labels(species), species, _crosswalk(species)).select("species_id", "key", "resolved")


@query("A28_unmatched_names", f"select key, cast(count(*) as bigint) as n from ({_RESOLVED}) r where resolved is null group by key", "species")
def _(species):
    return catalog.resolve_names(_labels(species), species, _crosswalk(species)).where("resolved is null").groupBy("key").agg(_b(F.count(F.lit(1)), "n"))


@query("A1_record_counts", "select species_id, pref, cast(count(*) as bigint) as n from records where record_accuracy = 'normal' and species_id in (select species_id from species) group by 1, 2", "records", "species")
def _(records, species):
    return catalog.record_counts(records, species)


@query("J2_ignored_records", "select reason, cast(count(*) as bigint) as n from (select case when record_accuracy <> 'normal' then 'accuracy' when species_id not in (select species_id from species where species_id % 5 <> 0) then 'name' end as reason from records) q where reason is not null group by 1", "records", "species")
def _(records, species):
    return catalog.ignored_records(records, species.where("species_id % 5 <> 0"))


@query("J4_taxon_profile", """with h as (select species_id, count(distinct rule_id) as environments, count(*) filter (where supported) as mapped, bit_or(class_mask) as classes from rules group by species_id),
c as (select species_id, count(distinct pref) as prefs, count(*) as records from records where record_accuracy = 'normal' group by species_id)
select s.species_id, s.genus, cast(coalesce(environments, 0) as bigint) as environments, cast(coalesce(mapped, 0) as bigint) as mapped, cast(coalesce(prefs, 0) as bigint) as prefs, cast(coalesce(records, 0) as bigint) as records, cast(coalesce(classes, 0) as bigint) as class_mask
from species s left join h using (species_id) left join c using (species_id)""", "species", "rules", "records")  # fmt: skip
def _(species, rules, records):
    mask = F.aggregate("classes", F.lit(0).cast(BIG), lambda m, c: m + F.call_function("shiftleft", F.lit(1).cast(BIG), c))
    return catalog.profiles(species, rules, records).withColumn("class_mask", mask).drop("classes")


_AREAS = "select species_id, pref, bool_or(island = 'mainland') as mainland, coalesce(array_to_string(list_sort(list(distinct island) filter (where island not in ('', 'mainland', 'unknown'))), ','), '') as islands, bool_or(island in ('', 'unknown')) as unspecified, cast(count(*) as bigint) as records from records where record_accuracy = 'normal' group by species_id, pref"


@query("A24_record_areas", _AREAS, "records")
def _(records):
    return scope.record_areas(records).withColumn("islands", F.array_join("islands", ","))


@query("A25_record_area_summary", f"select cast(count(*) as bigint) as areas, cast(count(distinct species_id) as bigint) as species, cast(count(*) filter (where mainland) as bigint) as mainland, cast(count(*) filter (where unspecified) as bigint) as unspecified, cast(count(*) filter (where islands <> '') as bigint) as islands from ({_AREAS}) a", "records")
def _(records):
    a = scope.record_areas(records)
    return a.agg(_b(F.count(F.lit(1)), "areas"), _b(F.countDistinct("species_id"), "species"), _b(F.count_if("mainland"), "mainland"), _b(F.count_if("unspecified"), "unspecified"), _b(F.count_if(F.size("islands") > 0), "islands"))


@query("W1_vocabulary_id", "select label, format('H{:03d}', row_number() over (order by encode(label))) as id from (select distinct label from labels_ja) l", "labels_ja")
def _(labels_ja):
    return catalog.vocabulary_ids(labels_ja)


@query("A22_genus_capacity", "select genus, cast(count(*) as bigint) as count from species where genus <> '' group by genus order by count(*) desc, genus limit 1", "species")
def _(species):
    return catalog.genus_capacity(species)


@query("J19_restore", "select cast(2 as bigint) as species_id, cast(0 as bigint) as pos union all select 1, 1 union all select 3, 5", "species")
def _(species):
    return catalog.restored("2,1,2,unknown,<script>,3,4", species, 3)


_PIXELS = f"select s.species_id, cast(m.pixels as bigint) as pixels from species s left join (select species_id, sum(n) as pixels from ({_match(limit=2)}) x group by species_id) m using (species_id)"


@query("O2_compare_rank", f"select species_id, pixels, cast(row_number() over (order by coalesce(pixels, -1) desc, species_id) as bigint) as rank, round(cast(pixels as double)/nullif(max(pixels) over (), 0), 6) as bar from ({_PIXELS}) p", "cell", "rules", "species")
def _(cell, rules, species):
    hit = predicate.matched(cell, rules, QuerySettings()).groupBy("species_id").agg(_b(F.sum("n"), "pixels"))
    return catalog.ranked(species.select("species_id").join(hit, "species_id", "left"))


@query("O4_genera", "select distinct genus from species order by genus", "species")
def _(species):
    return species.select("genus").distinct().orderBy("genus")


@query("J18_shared_selection", "select species_id, rule_id from habitat where rule_id in ('H101', 'H103')", "habitat")
def _(habitat):
    chosen = habitat.sparkSession.createDataFrame([("H101",), ("H103",)], "rule_id string")
    return habitat.join(F.broadcast(chosen), "rule_id", "left_semi").select("species_id", "rule_id")


@query("F12_search", "select species_id, name, genus from species where contains(lower(concat_ws(' ', name, genus)), lower('GENUS1'))", "species")
def _(species):
    return catalog.search(species, "GENUS1")


@query("O3_page", "select species_id, name from species order by species_id limit 20 offset 20", "species")
def _(species):
    return catalog.page(species, 20, 20).select("species_id", "name")


@query("F11_searchable", "select species_id from species s where exists (select 1 from rules r where r.species_id = s.species_id and rule_id in ('H001', 'H004'))", "species", "rules")
def _(species, rules):
    return species.join(rules.where(F.col("rule_id").isin("H001", "H004")), "species_id", "left_semi").select("species_id")


@query("F13_evaluable_rules", "select species_id, rule_id from habitat where supported and class_mask <> 0", "habitat")
def _(habitat):
    return habitat.where("supported and class_mask <> 0").select("species_id", "rule_id")


# ---- runs, map, geometry, neighbourhoods ---------------------------------------------------------------------

_RUNS = "select pref, idx as start, rid from (select *, lag(rid) over (partition by pref order by gy, gx) as last from (select *, cast(row_number() over (partition by pref order by gy, gx) - 1 as bigint) as idx from cell_region) a) b where idx = 0 or rid <> last"


@query("W2_encode_runs", _RUNS, "cell_region")
def _(cell_region):
    return runs.encode(cell_region, ["pref"], ["gy", "gx"], "rid")


@query("J13_attach_runs", "select gx, gy, pref, rid from cell_region", "cell_region")
def _(cell_region):
    places = runs.placed(cell_region, ["pref"], ["gy", "gx"], "rid")  # sorted once: codes and rows meet in the same ranges
    base, each = places
    return runs.attached((base.drop("rid"), each), runs.encoded(places, ["pref"], "rid"), ["pref"], "rid")


_TILES = "select cast(floor(gx/4.0) as bigint) as tx, cast(floor(gy/4.0) as bigint) as ty, cast(count(*) as bigint) as cells, min(gx) as west, min(gy) as south, max(gx) as east, max(gy) as north, list(distinct pref) as prefs from (select distinct gx, gy, pref from cell) c group by 1, 2"


@query("J16_tile_prune", f"select tx, ty, cells from ({_TILES}) t where west <= 12012 and east >= 12004 and south <= 15010 and north >= 15002 and list_has_any(prefs, [3, 7, 11])", "cell")
def _(cell):
    index = mapview.tiles(cell.select("gx", "gy", "pref").distinct(), 4)
    return mapview.pruned(index, (12004, 15002, 12012, 15010), [3, 7, 11]).select("tx", "ty", _b("cells"))


@query("F10_bbox", "select gx, gy, pref, cast(sum(n) as bigint) as n from cell where gx >= (137.52-100)*320-1 and gx <= (137.55-100)*320 and gy >= 31.26*480-1 and gy <= 31.28*480 group by 1, 2, 3", "cell")
def _(cell):
    return mapview.in_box(cell, 137.52, 31.26, 137.55, 31.28).groupBy("gx", "gy", "pref").agg(_b(F.sum("n"), "n"))


def _merged(x: str, y: str) -> str:
    return f"""with t as (select {x} as x, {y} as y, pref, sum(n) as total from cell group by 1, 2, 3), m as (select species_id, {x} as x, {y} as y, pref, sum(n) as matching from ({_match(limit=2)}) q group by 1, 2, 3, 4)
select species_id, x, y, cast(sum(matching) as bigint) as matching, cast(sum(total) as bigint) as total, array_to_string(list_sort(list(distinct pref)), ',') as prefs,
  cast(case when cast(sum(matching) as double)/sum(total) < 0.1 then 0 when cast(sum(matching) as double)/sum(total) < 0.3 then 1 else 2 end as bigint) as shade from m join t using (x, y, pref) group by species_id, x, y"""


@query("C9_map_detail", _merged("gx", "gy"), "cell", "rules")
def _(cell, rules):
    return mapview.merged(strata.evaluate(predicate.matched(cell, rules, QuerySettings()), cell))


@query("C9_map_coarse", _merged("cast(floor(gx/8.0)*8 as bigint)", "cast(floor(gy/8.0)*8 as bigint)"), "cell", "rules")
def _(cell, rules):
    coarse = strata.coarse(cell, 8, "pref", *predicate.DIMS).withColumnsRenamed({"x": "gx", "y": "gy"})
    return mapview.merged(strata.evaluate(predicate.matched(coarse, rules, QuerySettings()), coarse))


@query("A20_merge_pref", "select gx as x, gy as y, cast(sum(n) as bigint) as n, array_to_string(list_sort(list(distinct pref)), ',') as prefs from cell group by gx, gy", "cell")
def _(cell):
    return cell.groupBy(F.col("gx").alias("x"), F.col("gy").alias("y")).agg(_b(F.sum("n"), "n"), F.array_join(F.array_sort(F.collect_set("pref")), ",").alias("prefs"))


_DEG = lambda e: f"printf('%.6f', {e})"
_W, _E, _S, _N = (_DEG(x) for x in ("100+gx/320.0", "100+(gx+1)/320.0", "gy/480.0", "(gy+1)/480.0"))


@query("K6_geojson", f"""select species_id, gx, gy, pref, concat('{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[[', {_W}, ',', {_S}, '],[', {_E}, ',', {_S}, '],[', {_E}, ',', {_N}, '],[', {_W}, ',', {_N}, '],[', {_W}, ',', {_S}, ']]]}},"properties":{{"species_id":', species_id, ',"prefecture":', pref, ',"candidate_area_km2":', printf('%.6f', sum(n)*{_CELL_AREA}), ',"matching":', cast(sum(n) as bigint), '}}}}') as feature
from ({_match(limit=0)}) m where species_id = 1 group by species_id, gx, gy, pref""", "cell", "rules")  # fmt: skip
def _(cell, rules):
    one = rules.where("species_id = 1")
    return mapview.features(strata.evaluate(predicate.matched(cell, one, QuerySettings(distance=100)), cell))


@query("W5_last_layer", "select gx, gy, pref, veg as grp, legend from (select gx, gy, pref, veg, cover as legend, row_number() over (partition by gx, gy, pref order by veg desc, cover desc) as r from cell) q where r = 1", "cell")
def _(cell):
    return geometry.last_layer(cell.select("gx", "gy", "pref", F.col("veg").alias("grp"), F.col("cover").alias("legend")), ["gx", "gy", "pref"])


@query("J20_forest_edge", """with p as (select x, y, case when cover in (6,7,8,9,11) then 1 when cover > 0 then 2 end as kind from px)
select a.x, a.y, coalesce(bool_or(a.kind + b.kind = 3), false) as edge from p a left join p b on (b.x = a.x and abs(b.y - a.y) = 1) or (b.y = a.y and abs(b.x - a.x) = 1) group by a.x, a.y""", "px")  # fmt: skip
def _(px):
    return stencil.forest_edge(px)


@query("J21_distance_bins", """with t as (select x, y from px where cover = 1)
select p.x, p.y, cast(case when d2 <= 1 then 0 when d2 <= 6.25 then 1 when d2 <= 25 then 2 else 3 end as bigint) as bin
from px p left join (select a.x, a.y, min((a.x-t.x)*(a.x-t.x)+(a.y-t.y)*(a.y-t.y)) as d2 from px a join t on t.x between a.x-5 and a.x+5 and t.y between a.y-5 and a.y+5 group by a.x, a.y) q on q.x = p.x and q.y = p.y""", "px")  # fmt: skip
def _(px):
    return stencil.distance_bins(px, F.col("cover") == 1)


# ---- expressions ---------------------------------------------------------------------------------------------

_CODE = "select o_orderkey, format('{:02d}{:02d}{}{}{}{}', 30 + o_orderkey % 40, 20 + o_custkey % 30, o_orderkey % 8, o_custkey % 8, o_orderkey % 10, o_custkey % 10) as code from orders"


@query("P4_mesh_xy", f"select o_orderkey, code, cast(substr(code,3,2) as bigint)*80 + cast(substr(code,6,1) as bigint)*10 + cast(substr(code,8,1) as bigint) as x, cast(substr(code,1,2) as bigint)*80 + cast(substr(code,5,1) as bigint)*10 + cast(substr(code,7,1) as bigint) as y from ({_CODE}) q")
def _(spark, sf_dir):
    o = base(spark, sf_dir, "orders")
    code = F.format_string("%02d%02d%d%d%d%d", 30 + F.col("o_orderkey") % 40, 20 + F.col("o_custkey") % 30, F.col("o_orderkey") % 8, F.col("o_custkey") % 8, F.col("o_orderkey") % 10, F.col("o_custkey") % 10)
    return o.select("o_orderkey", code.alias("code")).withColumn("xy", grid.mesh_xy(F.col("code"))).select("o_orderkey", "code", "xy.x", "xy.y")


@query("P5_pixel_area", f"select c_custkey, round({_area('(20 + c_custkey % 26)')} * 1e6, 4) as square_metres from customer")
def _(spark, sf_dir):
    lat = (20 + F.col("c_custkey") % 26).cast("double")
    return base(spark, sf_dir, "customer").select("c_custkey", F.round(grid.pixel_area_km2(lat) * 1e6, 4).alias("square_metres"))


@query("P6_metres", f"with c as (select c_custkey, radians(20 + c_custkey % 26) as phi, 1 - {grid.E2!r}*pow(sin(radians(20 + c_custkey % 26)), 2) as q from customer) select c_custkey, round({grid.AXIS}*(1-{grid.E2!r})/pow(q, 1.5)*pi()/180/12000, 6) as dy, round({grid.AXIS}/sqrt(q)*cos(phi)*pi()/180/12000, 6) as dx from c")
def _(spark, sf_dir):
    m = base(spark, sf_dir, "customer").select("c_custkey", grid.metres((20 + F.col("c_custkey") % 26).cast("double")).alias("m"))
    return m.select("c_custkey", F.round("m.dy", 6).alias("dy"), F.round("m.dx", 6).alias("dx"))


@query("P7_height_bins", "select x, y, cast(case when height is null then 3 when height < 200 then 0 when height < 800 then 1 else 2 end as bigint) as h, cast(case when height is null then 31 when height >= 3000 then 30 else floor(height/100.0) end as bigint) as alt, cast(case when height is null then 3 when height < 300 then 0 when height < 1100 then 1 else 2 end as bigint) as band from px", "px")
def _(px):
    alt = grid.altitude_bin(F.col("height"))
    return px.select("x", "y", grid.height_band(F.col("height")).alias("h"), alt.alias("alt"), grid.band_of_bin(alt, 300, 1100).alias("band"))


@query("P8_distance_bin", "select x, y, cast(case when height <= 100 then 0 when height <= 250 then 1 when height <= 500 then 2 else 3 end as bigint) as bin from px", "px")
def _(px):
    return px.select("x", "y", grid.distance_bin(F.col("height")).alias("bin"))


@query("P12_query_key", "select k, case when cover = 0 then 0 else (1 + cover % 3)*512 + h*16 + cover end as qk, cast(sum(n) as bigint) as n from cell group by k, cover, h", "cell")
def _(cell):
    signature = F.when(F.col("cover") == 0, 0).otherwise(1 + F.col("cover") % 3)
    return cell.select("k", K.query_key(signature, F.col("h"), F.col("cover")).alias("qk"), "n").groupBy("k", "qk").agg(_b(F.sum("n"), "n"))


_RAW = "concat_ws('.', o_custkey % 19, o_orderkey % 8, case when o_orderkey % 3 = 0 then '6x' when o_orderkey % 3 = 1 then '01' else '-1' end, o_custkey % 16)"


@query("P15_excluded_classes", f"select o_orderkey, array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split({_RAW}, '.'), lambda x: regexp_matches(x, '^([1-9]|1[0-5])$')), lambda x: cast(x as bigint)))), ',') as classes from orders")
def _(spark, sf_dir):
    part = F.when(F.col("o_orderkey") % 3 == 0, "6x").when(F.col("o_orderkey") % 3 == 1, "01").otherwise("-1")
    raw = F.concat_ws(".", *(c.cast("string") for c in (F.col("o_custkey") % 19, F.col("o_orderkey") % 8, part, F.col("o_custkey") % 16)))
    return base(spark, sf_dir, "orders").select("o_orderkey", F.array_join(text.excluded(raw), ",").alias("classes"))


@query("P17_match_cell", "select gx, gy, pref, cast(sum(n) as bigint) as total, cast(sum(case when cover in (4, 5) then n else 0 end) as bigint) as matching, cast(sum(case when cover = 0 then n else 0 end) as bigint) as missing from cell group by 1, 2, 3", "cell")
def _(cell):
    n = F.col("n")
    return cell.groupBy("gx", "gy", "pref").agg(_b(F.sum(n), "total"), _b(F.sum(F.when(F.col("cover").isin(4, 4, 5), n).otherwise(0)), "matching"), _b(F.sum(F.when(F.col("cover") == 0, n).otherwise(0)), "missing"))


@query("P18_cell_box", "select distinct gx, gy, 100+gx/320.0 as west, gy/480.0 as south, 100+(gx+1)/320.0 as east, (gy+1)/480.0 as north from cell", "cell")
def _(cell):
    box = grid.cell_box(F.col("gx"), F.col("gy"))
    return cell.select("gx", "gy", *(v.cast("double").alias(k) for k, v in box.items())).distinct()


@query("P19_escape_html", """select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as escaped from pages""")
def _(spark, sf_dir):
    return base(spark, sf_dir, "pages").select("page_id", text.escape_html(F.col("html")).alias("escaped"))


@query("P24_vegetation_group", "select n, cast(case when label in ('果樹園', '常緑果樹園') then 1 when contains(label, '植林') then 2 when label = '牧草地' then 3 else 0 end as bigint) as grp from labels_ja", "labels_ja")
def _(labels_ja):
    return labels_ja.select("n", _b(labels.vegetation_group(F.col("label")), "grp"))


# ---- habitat descriptions ------------------------------------------------------------------------------------


def _has(pattern: str) -> str:
    return f"regexp_matches(label, '{pattern}')"


_URBAN = ", ".join(f"'{x}'" for x in labels.URBAN_LABELS)
_CLASSES = [(_has(labels.BAMBOO), "[11]"), (f"not {_has(labels.BAMBOO)} and {_has(labels.WOODS)}", "[6,7,8,9]"), (_has(labels.GRASS), "[5]"), ("contains(label, '水田') and not contains(label, '畦')", "[3]"), (_has(labels.FIELDS), "[3,4]"), (_has(labels.WETLAND), "[13]"), ("contains(label, '裸地')", "[10]"), (f"label in ({_URBAN})", "[2]")]
_WAIT = [(_has(labels.CLIMATE), labels.P_CLIMATE), (_has(labels.WATERSIDE), labels.P_WATER), (_has(labels.MICRO), labels.P_MICRO), ("contains(label, '水田') and contains(label, '畦')", labels.P_PADDY), (_has(labels.GARDEN), labels.P_GARDEN), (_has(labels.VILLAGE), labels.P_VILLAGE), (_has(labels.OTHER), labels.P_OTHER), (f"label in ({_URBAN})", labels.P_BUILDING)]


@query("F4_classify", f"""with q as (select n, label, {_has(labels.INDOOR)} as indoor, list_sort(list_distinct(flatten([{', '.join(f'case when {c} then {v} else [] end' for c, v in _CLASSES)}]))) as c, list_sort(flatten([{', '.join(f"case when {c} then ['{v}'] else [] end" for c, v in _WAIT)}])) as w from labels_ja)
select n, case when indoor then '' else array_to_string(c, ',') end as classes, case when indoor then concat(case when {_has(labels.CLIMATE)} then '{labels.P_INDOOR},{labels.P_CLIMATE}' else '{labels.P_INDOOR}' end) when len(c) = 0 and len(w) = 0 then '{labels.P_NONE}' else array_to_string(w, ',') end as pending from q""", "labels_ja")  # fmt: skip
def _(labels_ja):
    return labels.classify(labels_ja).select("n", F.array_join("classes", ",").alias("classes"), F.array_join("pending", ",").alias("pending"))


# ---- scope, layers and materialised views in single steps ------------------------------------------------------

_NORMAL = "(select * from records where record_accuracy = 'normal')"


@query("F2_quality_filter", "select species_id, pref, island from records where record_accuracy = 'normal' and species_id in (select species_id from species) and pref in (select pref from cell)", "records", "species", "cell")
def _(records, species, cell):
    known = scope.normal_records(records).join(species.select("species_id"), "species_id", "left_semi")
    return known.join(cell.select("pref").distinct(), "pref", "left_semi").select("species_id", "pref", "island")


@query("F3_prefectures", f"select distinct r.species_id, r.pref from {_NORMAL} r join (select distinct pref from cell where region = 3) p using (pref) join species s on s.species_id = r.species_id", "cell", "records", "species")
def _(cell, records, species):
    prefs = cell.select("pref", "region").distinct()
    return scope.prefectures(prefs, scope.record_areas(records), species, QuerySettings(region="3"))


_SCOPE = f"""with ra as (select species_id, pref, bool_or(island = '') as unspecified from {_NORMAL} r group by species_id, pref),
ch as (select ra.* from ra join (select distinct pref from cell) using (pref) join species using (species_id)),
ri as (select distinct pref, rid from cell_region),
res as (select species_id, pref, cast(null as bigint) as rid, cast(null as varchar) as label from ch where unspecified
  union all select distinct ch.species_id, ch.pref, case when r.island = 'mainland' then m.rid else v.rid end, r.island from ch join {_NORMAL} r using (species_id, pref)
    left join (select pref, rid from ri where rid = pref*10+1) m on m.pref = ch.pref
    left join (select a.island, a.pref, a.rid from island_alias a join ri on ri.pref = a.pref and ri.rid = a.rid) v on v.island = r.island and v.pref = ch.pref
    where not unspecified and r.island <> '')"""


def _scoped(cell, cell_region, records, island_alias, species):
    settings, areas = QuerySettings(), scope.record_areas(records)
    chosen = scope.prefectures(cell.select("pref", "region").distinct(), areas, species, settings)
    return scope.resolved(chosen, areas, island_alias, cell_region, settings)


@query("J14_record_scope", f"{_SCOPE} select species_id, pref, rid, label from res", "cell", "cell_region", "records", "island_alias", "species")
def _(cell, cell_region, records, island_alias, species):
    return _scoped(cell, cell_region, records, island_alias, species)


@query("J15_scoped_rows", f"""{_SCOPE}, t as (select pref, rid, sum(n) as total from cell join cell_region using (gx, gy, pref) group by pref, rid)
select species_id, pref, rid, cast(total as bigint) as total from (select species_id, pref from res where label is null) f join t using (pref) union all select species_id, pref, rid, cast(total as bigint) from (select distinct species_id, pref, rid from res where rid is not null) g join t using (pref, rid)""", "cell", "cell_region", "records", "island_alias", "species")  # fmt: skip
def _(cell, cell_region, records, island_alias, species):
    totals = strata.totals(cell.join(cell_region, ["gx", "gy", "pref"]), "pref", "rid").select("pref", "rid", _b("total"))
    return scope.in_scope(totals, _scoped(cell, cell_region, records, island_alias, species)).select("species_id", "pref", "rid", "total")


@query("J7_parent_mesh", "select p.pref, cast(count(*) as bigint) as n from px p join (select gx, gy, min(pref) as pref from cell group by gx, gy) m on m.gx = 12000 + cast(floor(p.x/5.0) as bigint) and m.gy = 15000 + cast(floor(p.y/5.0) as bigint) and m.pref = p.pref group by p.pref", "px", "cell")
def _(px, cell):
    parent = cell.groupBy("gx", "gy").agg(F.min("pref").alias("pref"))
    at = px.withColumns({"gx": F.floor(F.col("x") / 5) + 12000, "gy": F.floor(F.col("y") / 5) + 15000})
    return at.join(parent, ["gx", "gy", "pref"]).groupBy("pref").agg(_b(F.count(F.lit(1)), "n"))


@query("J8_layers", "select a.cover, b.veg, cast(count(*) as bigint) as n from px a join px b on a.x = b.x and a.y = b.y where b.height is not null group by 1, 2", "px")
def _(px):
    other = px.where("height is not null").select("x", "y", "veg")
    return px.select("x", "y", "cover").join(other, ["x", "y"]).groupBy("cover", "veg").agg(_b(F.count(F.lit(1)), "n"))


@query("J17_region_tiles", "select distinct cast(floor(gx/4.0) as bigint) as tx, cast(floor(gy/4.0) as bigint) as ty from cell_region where rid in (11, 32, 73)", "cell_region")
def _(cell_region):
    tile = cell_region.select(F.floor(F.col("gx") / 4).cast(BIG).alias("tx"), F.floor(F.col("gy") / 4).cast(BIG).alias("ty"), "rid").distinct()
    wanted = cell_region.sparkSession.createDataFrame([(11,), (32,), (73,)], "rid long")
    return tile.join(wanted, "rid", "left_semi").select("tx", "ty").distinct()


@query("A16_effective_species", "select species_id, cast(bit_or(case when supported then class_mask else 0 end) as bigint) as available, cast(bit_or(case when supported then class_mask & ~(1 << 6) else 0 end) as bigint) as classes, cast(count(*) as bigint) as selected, cast(count(*) filter (where supported and (class_mask & ~(1 << 6)) <> 0) as bigint) as mapped from habitat group by species_id", "habitat")
def _(habitat):
    return summary.effective(habitat, QuerySettings(excluded=(6,)))


@query("A27_legend_sizes", "select veg, cast(count(*) as bigint) as n from px group by veg", "px")
def _(px):
    return px.groupBy("veg").agg(_b(F.count(F.lit(1)), "n"))


@query("C3_group_views", f"""with b as (select cast(i as bigint) as base, i & 3 as bb, (i >> 2) & 3 as wb, (i >> 4) & 15 as cover, (i >> 8) & 3 as eb, (i >> 10) & 3 as rb, (i >> 12) & 7 as veg from (select unnest(generate_series(0, 24575)) as i) g),
f as (select base, {', '.join(f'cast({_flag(d)} as bigint) as {n}' for d, n in zip((0, 1, 2, None), compiler.FLAGS, strict=True))} from b cross join {_BITS} r group by base)
select pref, m100, m250, m500, cover_bits, h, cover, cast(sum(n) as bigint) as n from (select *, cast((k&15)|(((k>>6)&15)<<4)|(((k>>12)&3)<<8)|(((k>>14)&3)<<10)|(((k>>18)&7)<<12) as bigint) as base from cell) c join f using (base) where m100 + m250 + m500 + cover_bits > 0 group by all""", "cell", "rules")  # fmt: skip
def _(cell, rules):
    return summary.views(cell, compiler.compile_signatures(rules.sparkSession, rules)).withColumn("n", _b("n"))


@query("P20_units", "select pref, printf('%.3f', cast(sum(n) as double)*cast(0.01 as double)*100) as hectares, round(cast(sum(n) as double)*cast(0.01 as double), 1) as shown from cell group by pref", "cell")
def _(cell):
    n = F.sum("n") * F.lit(0.01).cast("double")
    return cell.groupBy("pref").agg(F.format_string("%.3f", n * 100).alias("hectares"), F.round(n, 1).alias("shown"))


# ---- sets, exports, sources ----------------------------------------------------------------------------------


@query("U1_union_scope", "select pref, cover, n from cell where region = 1 union all select pref, cover, n from cell where pref in (3, 7)", "cell")
def _(cell):
    c = cell.select("pref", "cover", _b("n"), "region")
    return c.where("region = 1").drop("region").unionByName(c.where("pref in (3, 7)").drop("region"))


@query("U2_union_classes", "select species_id, cast(bit_or(class_mask | base_mask) as bigint) as classes from habitat group by species_id", "habitat")
def _(habitat):
    return habitat.groupBy("species_id").agg(_b(F.bit_or(F.col("class_mask").bitwiseOR(F.col("base_mask"))), "classes"))


@query("U3_except", "select distinct island from records where island not in ('', 'mainland') except select island from island_alias", "records", "island_alias")
def _(records, island_alias):
    return records.where("island not in ('', 'mainland')").select("island").distinct().join(island_alias.select("island").distinct(), "island", "left_anti")


@query("U4_intersect", "select species_id from rules intersect select species_id from records where record_accuracy = 'normal'", "rules", "records")
def _(rules, records):
    return rules.select("species_id").intersect(scope.normal_records(records).select("species_id"))


@query("U5_parity", "select cast(0 as bigint) as broken", "px", "cell")
def _(px, cell):
    own = strata.cells_of_pixels(px)
    names = ["gx", "gy", "pref", "k", "alt", "n"]
    return checks.parity(own.select(names), cell.select(names))


_QUOTED = lambda e: f"""concat('"', replace(case when regexp_matches({e}, '^\\s*[=+@\\-]') then concat('''', {e}) else {e} end, '"', '""'), '"')"""


@query("K3_csv_lines", f"select concat_ws(',', {_QUOTED('cast(species_id as varchar)')}, {_QUOTED('formula')}, {_QUOTED('coalesce(quoted, ' + chr(39) * 2 + ')')}) as line from (select species_id, concat(case when species_id % 2 = 0 then ' =' else '-' end, name) as formula, case when species_id % 3 = 0 then concat('a\"b ', genus) end as quoted from species) s", "species")
def _(species):
    s = species.select("species_id", F.concat(F.when(F.col("species_id") % 2 == 0, " =").otherwise("-"), "name").alias("formula"), F.when(F.col("species_id") % 3 == 0, F.concat(F.lit('a"b '), "genus")).alias("quoted"))
    return export.csv_lines(s, "species_id", "formula", "quoted")


@query("K4_export_rows", f"select species_id, case when pixels is null then case species_id % 2 when 0 then 'no prefecture' else 'on hold' end else printf('%.3f', pixels*0.25*100) end as amount from ({_PIXELS}) p", "cell", "rules", "species")
def _(cell, rules, species):
    hit = predicate.matched(cell, rules, QuerySettings()).groupBy("species_id").agg(F.sum("n").alias("pixels"))
    rows = species.select("species_id").join(hit, "species_id", "left")
    return rows.select("species_id", export.amount(F.col("pixels") * 0.25, F.when(F.col("species_id") % 2 == 0, "no_scope").otherwise("unmapped"), "ha").alias("amount"))


@query("K5_pref_class_export", f"select species_id, pref, cover, cast(sum(n) as bigint) as pixels from ({_match(limit=2)}) m group by grouping sets ((species_id, pref), (species_id, pref, cover))", "cell", "rules")
def _(cell, rules):
    hit = predicate.matched(cell, rules, QuerySettings())
    return hit.groupingSets([["species_id", "pref"], ["species_id", "pref", "cover"]], "species_id", "pref", "cover").agg(_b(F.sum("n"), "pixels"))


@query("K2_packs", "with q as (select pref, cover, k, sum(n) as n from cell group by 1, 2, 3), f as (select pref, cover, string_agg(concat(k, ':', cast(n as bigint)), ',' order by k) as flat from q group by 1, 2) select pref, cover, substr(sha256(flat), 1, 12) as digest, cast(length(flat) as bigint) as bytes from f", "cell")
def _(cell):
    return export.manifest(export.packed(cell, "pref", "cover"), "pref", "cover")


@query("K8_overview_pack", "select cast(floor(gx/8.0)*8 as bigint) as x, cast(floor(gy/8.0)*8 as bigint) as y, pref, string_agg(concat(cover, ':', n), ',' order by cover) as counts from (select gx - gx % 8 as gx, gy - gy % 8 as gy, pref, cover, cast(sum(n) as bigint) as n from cell group by 1, 2, 3, 4) c group by 1, 2, 3", "cell")
def _(cell):
    c = strata.coarse(cell, 8, "pref", "cover")
    pairs = F.array_sort(F.collect_list(F.struct("cover", "n")))
    flat = F.array_join(F.transform(pairs, lambda p: F.concat(p["cover"].cast("string"), F.lit(":"), p["n"].cast("string"))), ",")
    return c.groupBy("x", "y", "pref").agg(flat.alias("counts"))


@query("S2_dictionary_decode", "select cast(s_suppkey as varchar) as id, s_name as name from supplier")
def _(spark, sf_dir):
    """Tables of at most 64 rows, each with the words that it needs, a table a line."""
    s = base(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 64).alias("part"), "s_suppkey", "s_name")
    words = F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name")))
    payload = s.groupBy("part").agg(F.transform(words, lambda w: w["s_name"]).alias("names"), F.transform(words, lambda w, i: F.array(w["s_suppkey"].cast("string"), i.cast("string"))).alias("rows"))
    path = shared_dir(spark)
    payload.select(F.array(F.lit("id"), F.lit("name")).alias("columns"), F.create_map(F.lit("name"), "names").alias("dictionaries"), "rows").write.json(path)
    return tables.read_dictionary_json(spark, path, lines=True).select("id", "name")


# ---- checks --------------------------------------------------------------------------------------------------

_NONE = "select cast(0 as bigint) as broken"
for _name, _views, _check in (
    ("V1_class_parity", ("px", "cell"), checks.class_parity),
    ("V2_no_duplicates", ("cell_region",), lambda r: checks.duplicates(r, "gx", "gy", "pref")),
    ("V4_detail_overview", ("cell",), checks.detail_equals_overview),
    ("V5_shape", ("cell",), checks.shape),
    ("V6_shared_cells", ("cell",), checks.shared_cells),
    ("V7_monotone", ("cell", "rules"), checks.monotone),
    ("V8_region_parity", ("cell", "cell_region"), checks.region_parity),
    ("V9_projection", ("cell",), lambda c: checks.parity(strata.marginalised(strata.marginalised(c, True, "pref"), False, "pref"), strata.marginalised(c, False, "pref"))),
    ("V10_compiled_cover", ("cell", "rules"), lambda c, r: checks.compiled_equals_native(c, r, QuerySettings(model="cover"))),
    ("F9_compiled_equals_native", ("cell", "rules"), lambda c, r: checks.compiled_equals_native(c, r, QuerySettings(model="elevation", distance=100))),
    ("V13_reband", ("cell",), checks.reband),
    ("J22_zip_parity", ("cell", "cell_region"), lambda c, r: checks.parity(c.select("gx", "gy", "pref").distinct(), r.select("gx", "gy", "pref"))),
    ("V15_candidates_within", ("cell", "rules"), lambda c, r: checks.candidates_within(c, r, QuerySettings())),
):
    query(_name, _NONE, *_views)(_check)


@query("V3_area_recomputed", f"select pref, round(sum(n*{_CELL_AREA}), 6) as area from cell group by pref", "cell")
def _(cell):
    return cell.groupBy("pref").agg(F.round(F.sum(F.col("n") * strata.area_of_cell(F.col("gy"))), 6).alias("area"))


from terrabin import catalogue_broken, catalogue_delivery, catalogue_files, catalogue_labels, catalogue_shapes, catalogue_steps, catalogue_streams  # noqa: E402, F401  (they register their queries)
