"""Checks on datasets that are broken on purpose: each check that counts 0 on a sound dataset must count what was broken."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrabin.catalogue import _accept, _match, query
from terrabin.operators import checks, predicate, strata
from terrabin.settings import QuerySettings
from terrabin.shipping import shared_dir
from terrabin.sources import sinks


def _parity(a: str, b: str) -> str:
    """Rows that only one of two statements returns, counted in SQL."""
    return f"select cast(count(*) as bigint) as broken from ((({a}) except all ({b})) union all (({b}) except all ({a}))) q"


_BY_CLASS = "select cover, cast(sum({n}) as bigint) as n from {t} group by cover"


@query("V1_lost_pixels", _parity("select cover, count(*) as n from px where x <> 7 group by cover", "select cover, cast(sum(n) as bigint) as n from cell group by cover"), "px", "cell")
def _(px, cell):
    return checks.class_parity(px.where("x <> 7"), cell)


@query("V4_lost_overview", _parity("select pref, k, cast(sum(n) as bigint) as n from cell group by 1, 2", "select pref, k, cast(sum(n) as bigint) as n from cell where gx % 5 <> 0 group by 1, 2"), "cell")
def _(cell):
    return checks.detail_equals_overview(cell, cell.where("gx % 5 <> 0"))


@query("V6_crowded_cells", "select cast(count(*) as bigint) as broken from (select gx, gy, sum(n) as n from cell group by 1, 2) q where case when gx % 7 = 0 then n * 60 else n end > 950", "cell")
def _(cell):
    return checks.shared_cells(cell.withColumn("n", F.when(F.col("gx") % 7 == 0, F.col("n") * 60).otherwise(F.col("n"))))


_SETS = "(select distinct s.species_id, cover, h, veg, wb, bb, eb, rb, cb, vb from (select distinct species_id from rules) s cross join (select distinct cover, h, veg, wb, bb, eb, rb, cb, vb from cell where cover = 8) c where exists (select 1 from rules q where q.species_id = s.species_id and {a}))"


@query("V7_shrinking_sets", f"select cast((select count(*) from {_SETS.format(a=_accept(1))} a) + (select count(*) from {_SETS.format(a=_accept(2, 'elevation'))} b) as bigint) as broken", "cell", "rules")
def _(cell, rules):
    """The sets at 500 m have lost a class that those at 250 m and by elevation have."""
    sets = checks.accepted(cell, rules)
    return checks.nested(sets | {500: sets[500].where("cover <> 8")})


_PUBLIC = "select pref, cast(k & ~({mask}) as bigint) as k, cast(sum(n) as bigint) as n from cell where {part} group by 1, 2"


@query("V9_broken_projection", _parity(_PUBLIC.format(mask="3072|196608|48", part="pref <> 3"), _PUBLIC.format(mask="3072|196608|48", part="true")), "cell")
def _(cell):
    """An edition projected from one that has lost a prefecture, against one from the cells."""
    once = strata.marginalised(cell, True, "pref").where("pref <> 3")
    return checks.parity(strata.marginalised(once, False, "pref"), strata.marginalised(cell, False, "pref"))


for _name, _how, _settings in (
    ("V10_missing_species", dict(model="cover"), QuerySettings(model="cover")),
    ("F9_missing_species", dict(limit=0, model="elevation"), QuerySettings(model="elevation", distance=100)),
):

    @query(_name, f"select cast(count(*) as bigint) as broken from (select distinct species_id, pref from ({_match(**_how)}) m where species_id = 3) q", "cell", "rules")
    def _(cell, rules, settings=_settings):
        """Compiled from rules that lack a species."""
        return checks.compiled_equals_native(cell, rules, settings, rules.where("species_id <> 3"))


_COARSE = "select pref, cast(floor(gx / 8e0) * 8 as bigint) as x, cast(floor(gy / 8e0) * 8 as bigint) as y, cast(sum(n) as bigint) as n from cell where {part} group by 1, 2, 3"


@query("V11_lost_packs", _parity(_COARSE.format(part="pref not in (4, 9)"), _COARSE.format(part="true")), "cell")
def _(cell):
    path = shared_dir(cell.sparkSession)
    sinks.write_packs(cell.where("pref not in (4, 9)"), path)
    return checks.parity(checks.coarse_sums(sinks.read_packs(cell.sparkSession, path)), checks.coarse_sums(cell))


_BAND = "cast(case when alt = 31 then 3 when alt * 100 < 200 then 0 when alt * 100 < 800 then 1 else 2 end as bigint)"


@query("V13_shifted_bins", _parity(f"select pref, cover, {_BAND} as h, cast(sum(n) as bigint) as n from (select pref, cover, n, case when pref = 5 and alt < 31 then alt + 2 else alt end as alt from cell) s group by 1, 2, 3", "select pref, cover, h, cast(sum(n) as bigint) as n from cell group by 1, 2, 3"), "cell")
def _(cell):
    """Altitude bins of a prefecture are two too high; bin 30 and more become the missing one or none."""
    return checks.reband(cell.withColumn("alt", F.when((F.col("pref") == 5) & (F.col("alt") < 31), F.col("alt") + 2).otherwise(F.col("alt"))))


@query("V15_lost_totals", f"with m as (select species_id, gx, gy, pref, sum(n) as matching from ({_match(limit=2)}) x group by 1, 2, 3, 4), t as (select gx, gy, pref, sum(n) as total from cell where cover <> 8 group by 1, 2, 3) select cast(count(*) as bigint) as broken from m join t using (gx, gy, pref) where matching > total", "cell", "rules")
def _(cell, rules):
    hit = strata.evaluate(predicate.matched(cell, rules, QuerySettings()), cell.where("cover <> 8"))
    return checks.broken(hit, F.col("matching") > F.col("total"))


@query("J22_lost_cells", _parity("select distinct gx, gy, pref from cell", "select gx, gy, pref from cell_region where gx % 11 <> 0"), "cell", "cell_region")
def _(cell, cell_region):
    return checks.parity(cell.select("gx", "gy", "pref").distinct(), cell_region.where("gx % 11 <> 0").select("gx", "gy", "pref"))


@query("U5_repeated_rows", _parity("select species_id, pref from records union all select species_id, pref from records where pref = 2", "select species_id, pref from records"), "records")
def _(records):
    """Rows that one table has more often than the other count as often."""
    rows = records.select("species_id", "pref")
    return checks.parity(rows.unionAll(rows.where("pref = 2")), rows)
