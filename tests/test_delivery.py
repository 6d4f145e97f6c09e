"""Views, editions, manifests and streams: what must fail does, and what is repeated changes nothing."""

import json

import pytest
from pyspark.sql import functions as F

from terrabin.operators import delivery, packs, policy
from terrabin.catalogue_delivery import MANIFEST, PACK
from terrabin.shipping import shared_dir
from terrabin.streaming.records import Counts
from terrabin.views import view


def test_pairs_and_signatures(spark, sf):
    rules = view(spark, sf, "habitat")
    bits = delivery.group_rules(rules).select("grp", "bit", "rule_id").collect()
    by = {}
    for r in bits:
        by.setdefault(r.grp, []).append((r.bit, r.rule_id))
    assert all([b for b, _ in sorted(v)] == list(range(len(v))) and [i for _, i in sorted(v)] == sorted(i for _, i in v) for v in by.values())
    bases = spark.range(24576).withColumnRenamed("id", "base")
    rows = delivery.group_signatures(rules, bases)
    assert rows.where("m100 & ~m250 <> 0 or m250 & ~m500 <> 0").count() == 0  # what is near at 100 m is near at 250
    assert rows.groupBy("grp", "base").count().where("count > 1").count() == 0


def cells(spark):
    return spark.createDataFrame([(12000, 15000, 1, 11, 6 * 64 + 16, 5), (12001, 15000, 1, 0, 5 * 64 + 3072, 2), (12070, 15100, 2, 21, 6 * 64 + 32, 7)], "gx long, gy long, pref long, rid long, k long, n long")


def test_an_edition_keeps_all_land(spark):
    out = policy.project(cells(spark), shared_dir(spark))
    assert {o: sum(r.n for r in df.collect()) for o, df in out.items()} == {"tiles": 14, "overview": 14, "summary": 14, "regions": 12}
    assert sorted((r.pref, r.k, r.n) for r in out["summary"].collect()) == [(1, 5 * 64, 2), (1, 6 * 64, 5), (2, 6 * 64, 7)]
    assert {o: df.count() for o, df in policy.project(cells(spark).where("n > 100"), shared_dir(spark)).items()} == dict.fromkeys(policy.OUTPUTS, 0)


def test_lost_land_is_an_error(spark, monkeypatch):
    whole = policy.projection
    monkeypatch.setattr(policy, "projection", lambda c, *a: whole(c, *a).where("output <> 'overview' or pref = 1"))
    with pytest.raises(ValueError, match="outputs differ"):
        policy.project(cells(spark), shared_dir(spark))


def good():
    d = "0123456789abcdef" * 4
    info = lambda p, **more: {"file": f"{p}-{d[:12]}.json.gz", "sha256": d, "bytes": 10, "decodedBytes": 20, **more}
    return {"schema": 1, "sourceManifestSHA256": d, "summary": info("summary"), "prefectures": {"1": info("map-pref-1", cells=3), "47": info("map-pref-47", cells=0)}}


@pytest.mark.parametrize(
    "change,path,reason",
    [
        (lambda m: None, None, None),
        (lambda m: m.update(schema=2), "schema", "range"),
        (lambda m: m.update(schema="x"), "schema", "not whole"),
        (lambda m: m.pop("summary"), "summary", "missing"),
        (lambda m: m.update(sourceManifestSHA256="AB"), "sourceManifestSHA256", "pattern"),
        (lambda m: m["summary"].update(file="../summary-0123456789ab.json.gz"), "summary.file", "pattern"),
        (lambda m: m["summary"].update(file="summary-ffffffffffff.json.gz"), "summary.file", "digest"),
        (lambda m: m["summary"].pop("bytes"), "summary.bytes", "missing"),
        (lambda m: m["prefectures"]["47"].update(bytes=1.5), "prefectures.47.bytes", "not whole"),
        (lambda m: m["prefectures"]["1"].update(cells=20001), "prefectures.1.cells", "range"),
        (lambda m: m["prefectures"]["47"].update(file=m["prefectures"]["1"]["file"]), "prefectures.47.file", "pattern"),
        (lambda m: m["prefectures"]["1"].update(decodedBytes=64000001), "prefectures.1.decodedBytes", "range"),
        (lambda m: m.update(prefectures={}), None, None),
    ],
)
def test_manifest_faults(spark, change, path, reason):
    m = good()
    change(m)
    rows = spark.createDataFrame([(1, json.dumps(m))], "id long, manifest string")
    assert [tuple(r) for r in packs.faults(rows, "manifest", MANIFEST, "id").collect()] == ([(1, path, reason)] if path else [])


def test_text_that_is_no_manifest(spark):
    rows = spark.createDataFrame([(1, "not json"), (2, None), (3, "{}")], "id long, manifest string")
    got = {(r.id, r.path): r.reason for r in packs.faults(rows, "manifest", MANIFEST, "id").collect()}
    assert got[3, "prefectures"] == "missing" and got[3, "schema"] == "missing"
    assert got[2, ""] == "missing" and any(i == 1 and r == "missing" for (i, _), r in got.items())


def test_pack_faults(spark):
    cells = [[12000, 15000, 5, [64, 1, 128, 2]], [1, 15000, 5, [64, 1]], [12000, 15000, 48, [128, 2, 64, 1]], [12000, 15000, 5, [64, 0, 65]], [12000, "x", 5, []], [12000, 15000, 5]]
    rows = spark.createDataFrame([(1, json.dumps({"cells": cells}))], "id long, pack string")
    got = sorted((r.cell, r.field) for r in packs.pack_faults(rows, "pack", PACK, "id").collect())
    assert got == [(1, "gx"), (2, "order"), (2, "pref"), (3, "cell"), (3, "count"), (4, "gy"), (5, "cell")]


def test_a_repeated_batch_counts_once(spark):
    c = Counts(spark, shared_dir(spark), ["k"], ["n"], lambda rows: rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    batch = lambda *v: spark.createDataFrame([(x,) for x in v], "k string")
    now = lambda: {r.k: r.n for r in c.current().collect()}
    c.merge(batch("a", "b", "a"), 0)
    c.merge(batch("a"), 1)
    assert now() == {"a": 3, "b": 1}
    c.merge(batch("a"), 1)  # the same batch after a failure
    assert now() == {"a": 3, "b": 1}
    assert c.fold() == 1 and now() == {"a": 3, "b": 1}
    c.merge(batch("c"), 2)
    c.merge(batch("c"), 2)
    assert now() == {"a": 3, "b": 1, "c": 1}
    assert c.fold() == 2 and c.fold() == 2 and now() == {"a": 3, "b": 1, "c": 1}


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_broken_datasets_have_something_to_find(scale):
    """The statements that broken checks must equal count something, so that a check that sees nothing fails."""
    import duckdb

    from terrabin import catalogue, catalogue_broken  # noqa: F401
    from terrabin.views import BASE

    duck = duckdb.connect()
    for t in BASE:
        duck.execute(f"create view {t} as select * from read_parquet('/root/testdata/{scale}/{t}.parquet')")
    names = "V1_lost_pixels V4_lost_overview V6_crowded_cells V7_shrinking_sets V9_broken_projection V10_missing_species V10_broken_views F9_missing_species V11_lost_packs V13_shifted_bins V15_lost_totals J22_lost_cells U5_repeated_rows"
    for name in names.split():
        assert duck.execute(catalogue.oracle_sql()[name]).fetchone()[0] > 0, name


_CELL = "gx long, gy long, pref long, cover long, k long, n long"


def test_manifests_and_packs_of_a_region_beyond_the_bounds(spark):
    """More cells than a map file may list, and rows beyond the grid's last: sound as they are, and only the faults of broken ones."""
    from terrabin import catalogue_delivery as c

    tall = spark.range(150 * 150).selectExpr("12000 + id % 150 as gx", "24900 + cast(floor(id / 150) as bigint) as gy", "8L as pref", "5L as cover", "320L as k", "1L as n")
    few = spark.createDataFrame([(12000, 15000, 3, 5, 320, 1), (12001, 25001, 3, 6, 384, 2)], _CELL)
    cells = tall.unionByName(few)
    assert packs.faults(c._manifest(cells, False), "manifest", c.MANIFEST, "pref").count() == 0
    assert {(r.pref, r.path, r.reason) for r in packs.faults(c._manifest(cells, True), "manifest", c.MANIFEST, "pref").collect()} == {(3, f"prefectures.{k}.bytes", "range") for k in (5, 6)} | {(8, "prefectures.5.file", "pattern")}
    assert {(r.cover, r.pref): r.cells for r in c._map_cells(cells).collect()} == {(5, 8): 75 * 75, (5, 3): 1, (6, 3): 1}
    assert packs.pack_faults(c._packs(cells, False), "pack", PACK, "pref", "ty").count() == 0
    broken = packs.pack_faults(c._packs(cells, True), "pack", PACK, "pref", "ty")
    assert {(r.pref, r.field, r.n, r.rows) for r in broken.groupBy("pref", "field").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ty").alias("rows")).collect()} == {(3, "gx", 2, 2), (8, "gx", 22500, 38)}


def test_a_scope_is_summed_once_for_all_who_share_it(spark, sf, monkeypatch):
    """Species of a group and scope share stored sums; views are the same whether tasks and files are few or many."""
    from terrabin import shipping

    rules = view(spark, sf, "habitat").where("supported")
    alike = rules.where("species_id = 1")
    rules = alike.unionByName(alike.withColumn("species_id", F.lit(101).cast("bigint"))).unionByName(alike.withColumn("species_id", F.lit(102).cast("bigint"))).unionByName(rules.where("species_id = 2"))
    whole = "species_id long, pref long, rid long, label string"
    scopes = spark.createDataFrame([(1, 1, None, None), (1, 2, 21, None), (101, 2, 21, None), (101, 1, None, None), (102, 1, None, None), (2, 1, None, None), (2, 2, None, "isl9")], whole)
    cell, region = view(spark, sf, "cell"), view(spark, sf, "cell_region")
    joined = shipping.stored(cell.where("pref in (1, 2)").join(region, ["gx", "gy", "pref"]), "cells")

    def made():
        d = delivery.Delivery(spark, shared_dir(spark))
        d.refresh(joined, rules, scopes, step=8)
        rows = {n: sorted(map(str, d.view(n).collect())) for n in ("map", "summary", "regions", "national")}
        by = {}
        for r in d.view("recorded").collect():
            by.setdefault(r.species_id, []).append((*(r[c] for c in delivery.SIGNED), r.n))
        return d, rows, {k: sorted(v) for k, v in by.items()}

    d, rows, by = made()
    assert by[1] == by[101] and sum(v[-1] for v in by[102]) == sum(r.n for r in d.view("summary").where("pref = 1").join(d.view("recorded").where("species_id = 102").select("grp").distinct(), "grp").collect())
    assert spark.read.parquet(f"{d.path}/recorded").count() == len(by[1]) + len(by[102]) + len(by.get(2, []))
    monkeypatch.setattr(shipping, "TASK_ROWS", 20)
    monkeypatch.setattr(delivery, "TASK_ROWS", 20)
    monkeypatch.setattr(delivery, "FOLDERS", 2)
    assert made()[1:] == (rows, by)


def test_batches_do_not_grow_with_the_table(spark, sf, monkeypatch):
    from terrabin import catalogue_streams as c

    px = view(spark, sf, "px")
    want = sorted(map(tuple, view(spark, sf, "cell").groupBy("gx", "gy", "pref", "region", "k", "alt").agg(F.sum("n")).collect()))
    monkeypatch.setattr(c, "TASK_ROWS", 150)
    monkeypatch.setattr(c, "BATCH", 3)
    path = shared_dir(spark)
    counts = Counts(spark, f"{path}/counts", ["gx", "gy", "pref", "region", "k", "alt"], ["n"], c.strata.cells_of_pixels)
    got = sorted(map(tuple, c._streamed(px, "x", counts, f"{path}/in").collect()))
    assert got == want
    batches = spark.read.parquet(f"{path}/counts/batches").groupBy("batch").agg(F.sum("n").alias("n")).collect()
    assert len(batches) == 8 and max(r.n for r in batches) < 450


def test_cells_and_records_in_tasks_of_bounded_rows(spark, sf, monkeypatch):
    """Large tables are dealt to tasks by their rows, not by the session's partitions; the rows stay the same."""
    from terrabin import shipping, views

    whole = {n: sorted(map(str, view(spark, sf, n).collect())) for n in ("cell", "cell_region", "records")}
    monkeypatch.setattr(shipping, "TASK_ROWS", 200)
    monkeypatch.setattr(views, "CELL_ROWS", 100)
    for n, rows in whole.items():
        parts = [len(p) for p in view(spark, sf, n).rdd.glom().collect()]
        assert max(parts) < 600 and len(parts) == {"records": 30}.get(n, 15), (n, parts)
        assert sorted(map(str, view(spark, sf, n).collect())) == rows
    cells = shipping.stored(view(spark, sf, "cell").join(view(spark, sf, "cell_region"), ["gx", "gy", "pref"]), "cells")
    few, many = delivery.facts(cells, 8), delivery.facts(cells, 8, cells.count())
    assert many.rdd.getNumPartitions() > 4 and sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    signed = shipping.stored(delivery.group_signatures(view(spark, sf, "habitat"), few.select("base").distinct()), "signed")
    maps = [delivery.expanded(df, signed).where("view = 'map'") for df in (few, shipping.dealt(few, 5000, "pref", "x", "y"))]
    assert maps[1].rdd.getNumPartitions() == 25 and sorted(map(str, maps[0].collect())) == sorted(map(str, maps[1].collect()))


def test_views_are_checked_against_raw_cells(spark, sf, monkeypatch):
    """Facts that lose a prefecture are found: the check does not sum the cells as the delivery does."""
    from terrabin import catalogue

    whole = delivery.facts
    monkeypatch.setattr(delivery, "facts", lambda *a: whole(*a).where("pref <> 1"))
    assert catalogue.queries()["V10_compiled_views"](spark, sf).first()["broken"] > 0
