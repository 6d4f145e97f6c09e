"""Literal expectations for single operators."""

import gzip
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from terrabin.functions import grid, text
from terrabin.functions import strata as K
from terrabin.operators import catalog, checks, compiler, geometry, labels, mapview, policy, predicate, runs, scope, stencil, summary
from terrabin.plans import planner
from terrabin.settings import QuerySettings, approval, excluded_classes, publication_profile, thresholds
from terrabin.sources import sinks, tables
from terrabin.streaming.records import windowed_counts

RULE = "species_id long, rule_id string, class_mask int, base_mask int, water boolean, built boolean, edge boolean, rice boolean, coast boolean, river boolean, veg int, elev_mask int, elev_required boolean, supported boolean"


def rule(species, rid, classes=(), base=None, veg=0, elev=(0, 1, 2, 3), required=False, supported=True, **near):
    mask = lambda cs: sum(1 << c for c in cs)
    return (species, rid, mask(classes), mask(classes if base is None else base), *(bool(near.get(f)) for f in ("water", "built", "edge", "rice", "coast", "river")), veg, mask(elev), required, supported)


def cells(spark, rows):
    """rows of (cover, n, overrides)."""
    dims = ("cover", "h", "alt", "veg", "wb", "bb", "eb", "rb", "cb", "vb")
    data = []
    for cover, n, over in rows:
        d = dict.fromkeys(dims, 3) | {"veg": 0, "h": 0, "alt": 0, "cover": cover} | over
        data.append((12000, 15000, over.get("pref", 1), 0, *(d[k] for k in dims), n))
    df = spark.createDataFrame(data, "gx long, gy long, pref long, region long, " + ", ".join(f"{d} long" for d in dims) + ", n long")
    return df.withColumn("k", K.pack(**{d: F.col(d) for d in K.BITS}))


def total(df):
    return {r[0]: r[1] for r in df.groupBy("species_id").agg(F.sum("n")).collect()}


def test_mesh_code(spark):
    one = spark.createDataFrame([("53394525",)], "c string").select(grid.mesh_xy(F.col("c")).alias("m")).first().m
    assert (one.x, one.y) == (3175, 4282) and (100 + 3175 / 80, round(4282 / 120, 5)) == (139.6875, 35.68333)
    with pytest.raises(Exception, match="invalid mesh code"):
        spark.createDataFrame([("53398925",)], "c string").select(grid.mesh_xy(F.col("c"))).collect()


def test_areas(spark):
    a = [r[0] for r in spark.createDataFrame([(25.0,), (35.0,), (45.0,)], "lat double").select(grid.pixel_area_km2(F.col("lat"))).collect()]
    assert a[0] > a[1] > a[2] and math.isclose(a[1], 7.033e-5, rel_tol=1e-3)


def test_csv_fields(spark):
    r = spark.createDataFrame([("=1+1", 'a"b', None)], "a string, b string, c string").select(text.csv_line(F.col("a"), F.col("b"), F.col("c"))).first()[0]
    assert r == '"\'=1+1","a""b",""'


def test_settings():
    assert excluded_classes("8.6.8.0.16.-1.6x..NaN") == (6, 8)
    assert [thresholds(*x) for x in ((0, 800), (200, 200), (250, 800), (200, 3100), (float("nan"), 1), (300, 900))] == [(200, 800)] * 5 + [(300, 900)]
    for bad in ({"distance": 300}, {"model": "x"}, {"scope": "y"}):
        with pytest.raises(ValueError):
            QuerySettings(**bad)


def test_editions():
    assert publication_profile("public", False, False) == {"elevation": False, "preview": False}
    with pytest.raises(ValueError):
        publication_profile("public", True, False)
    with pytest.raises(ValueError):
        approval({"status": "approved"})


def test_near_water_and_exclusion(spark):
    c = cells(spark, [(6, 2, {"wb": 0}), (8, 3, {"wb": 0}), (6, 5, {"wb": 3}), (8, 7, {"wb": 3})])
    r = spark.createDataFrame([rule(1, "H001", (6, 8), water=True)], RULE)
    assert total(predicate.matched(c, r, QuerySettings(distance=100))) == {1: 5}
    assert total(predicate.matched(c, r, QuerySettings(distance=100, excluded=(6,)))) == {1: 3}
    state = predicate.any_possible(r, QuerySettings(excluded=(6, 8))).first()
    assert not state.mapped and state.has_classes


def test_union_counts_once(spark):
    c = cells(spark, [(5, 3, {"vb": 0}), (5, 5, {"veg": 3}), (5, 7, {"vb": 0, "veg": 3}), (5, 11, {})])
    r = spark.createDataFrame([rule(1, "a", (5,), river=True), rule(1, "b", (5,), veg=3)], RULE)
    assert total(predicate.matched(c, r, QuerySettings(distance=100))) == {1: 15}


def test_elevation_thresholds(spark):
    c = cells(spark, [(6, n, {"alt": a}) for a, n in ((1, 1), (5, 2), (7, 3), (8, 5), (10, 7), (31, 11))])
    r = spark.createDataFrame([rule(1, "a", (6,), elev=(2,))], RULE)
    got = [total(predicate.matched(c, r, QuerySettings(fine=True, mountain=m))).get(1) for m in (800, 500, 1000)]
    assert got == [12, 17, 7]


def test_elevation_is_a_subset_and_missing_height_needs_band_3(spark):
    c = cells(spark, [(6, 1, {"h": 3}), (6, 2, {"h": 1})])
    for bands, want in (((0, 1, 2), 2), ((0, 1, 2, 3), 3)):
        r = spark.createDataFrame([rule(1, "a", (6,), elev=bands)], RULE)
        assert total(predicate.matched(c, r, QuerySettings(model="elevation"))) == {1: want}
    assert checks.monotone(c, r).first()[0] == 0


@pytest.mark.parametrize("model", ["distance", "elevation", "cover"])
@pytest.mark.parametrize("distance", [100, 250, 500])
def test_compiled_equals_native_on_every_base(spark, model, distance):
    rules = spark.createDataFrame([rule(1, "a", (5, 6), water=True), rule(1, "b", (6, 9), edge=True, elev=(2,), required=True), rule(2, "c", (3,), base=(3, 4), rice=True, veg=2), rule(3, "d", (11,), built=True, elev=(0, 1)), rule(4, "e", (5,), supported=False)], RULE)
    every = compiler.bases(spark).crossJoin(spark.range(4).select(F.col("id").alias("h")))
    c = every.select(F.lit(0).alias("gx"), F.lit(0).alias("gy"), (F.col("base") % 7).alias("pref"), "cover", "h", F.lit(0).alias("alt"), "veg", "wb", "bb", "eb", "rb", F.lit(3).alias("cb"), F.lit(3).alias("vb"), F.lit(1).cast("long").alias("n"))
    c = c.withColumn("k", K.pack(**{d: F.col(d) for d in K.BITS}))
    for chosen in ({}, {1: ["b"], 3: []}):
        assert checks.compiled_equals_native(c, rules, QuerySettings(model=model, distance=distance, habitats=chosen, excluded=(9,))).first()[0] == 0


def test_every_status(spark):
    c = cells(spark, [(5, 10, {"pref": p}) for p in (1, 2, 3)])
    region = c.select("gx", "gy", "pref", (F.col("pref") * 10 + 1).alias("rid"))
    species = spark.createDataFrame([(i,) for i in range(1, 8)], "species_id long")
    rules = spark.createDataFrame([rule(i, "a", (5,)) for i in (1, 2, 3, 4, 7)] + [rule(5, "x", supported=False), rule(4, "u", supported=False)], RULE)
    record = [(1, 1, "mainland"), (3, 2, "nowhere"), (4, 1, ""), (5, 1, ""), (7, 1, "mainland"), (7, 2, "nowhere")]
    records = spark.createDataFrame([(*r, "normal") for r in record], "species_id long, pref long, island string, record_accuracy string")
    none = spark.createDataFrame([], "island string, pref long, rid long")
    got = {r.species_id: (r.status, r.pixels) for r in summary.summaries(c, region, rules, species, records, none, QuerySettings()).collect()}
    assert got == {1: ("evaluated", 10), 2: ("no_scope", None), 3: ("no_geography", None), 4: ("partial_environment", 10), 5: ("unmapped", None), 6: ("unmapped", None), 7: ("partial_geography", 10)}
    got = {r.species_id: r.status for r in summary.summaries(c, region, rules, species, records, none, QuerySettings(excluded=(5,))).collect()}
    assert got[1] == "no_landcover"
    got = {r.species_id: r.status for r in summary.summaries(c, region, rules, species, records, none, QuerySettings(habitats={1: []})).collect()}
    assert got[1] == "no_environment"


def test_record_areas(spark):
    rows = [(1, 1, "奄美大島", "normal")] * 2 + [(1, 1, "unknown", "normal"), (1, 1, "x", "suspect")]
    r = scope.record_areas(spark.createDataFrame(rows, "species_id long, pref long, island string, record_accuracy string")).first()
    assert (r.mainland, r.islands, r.unspecified) == (False, ["奄美大島"], True)


def test_policy_is_idempotent(spark):
    rules = spark.createDataFrame([rule(1, "a", (6,), elev=(2,), coast=True, river=True), rule(1, "b", (6,))], RULE)
    once = policy.publication_rules(rules)
    twice = policy.publication_rules(once)
    assert once.orderBy("rule_id").collect() == twice.orderBy("rule_id").collect()
    a = once.where("rule_id = 'a'").first()
    assert a.hold == "coast,height,river" and a.class_mask == 0 and not a.supported
    assert policy.publication_rules(rules, True).where("rule_id = 'b'").first().supported


def test_distance_bins(spark):
    px = spark.createDataFrame([(x, 0) for x in range(60)], "x long, y long")
    got = {r.x: r.bin for r in stencil.distance_bins(px, F.col("x") == 1, 10.0, 10.0).collect()}
    assert [got[x] for x in (1, 11, 12, 26, 27, 51, 52)] == [0, 0, 1, 1, 2, 2, 3]
    assert {r.bin for r in stencil.distance_bins(px, F.lit(False), 10.0, 10.0).collect()} == {3}
    grid_ = spark.createDataFrame([(x, y) for x in range(14) for y in range(14)], "x long, y long")
    got = {(r.y, r.x): r.bin for r in stencil.distance_bins(grid_, (F.col("x") == 1) & (F.col("y") == 1), 8.0, 6.0, tile=5).collect()}
    assert (got[11, 11], got[11, 12]) == (0, 1)


def test_edges_ignore_unknown_cover(spark):
    px = spark.createDataFrame([(0, 0, 0), (1, 0, 6), (2, 0, 6), (3, 0, 5), (4, 0, 0), (5, 0, 5), (7, 0, 6)], "x long, y long, cover long")
    assert {r.x for r in stencil.forest_edge(px).where("edge").collect()} == {2, 3}


def test_runs_round_trip_and_checks(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([7, 7, 3, 3, 3, 7])], "p long, i long, v long")
    coded = runs.encode(df, ["p"], ["i"], "v")
    assert sorted((r.start, r.v) for r in coded.collect()) == [(0, 7), (2, 3), (5, 7)]
    back = runs.attach(df.drop("v"), coded, ["p"], ["i"], "v")
    assert back.select("p", "i", "v").exceptAll(df).count() == 0
    wide = spark.range(2000).selectExpr("id % 3 as p", "id as i", "if(id % 11 < 6, null, id div 300) as v")
    again = runs.attach(wide.drop("v"), runs.encode(wide, ["p"], ["i"], "v"), ["p"], ["i"], "v")
    assert again.select("p", "i", "v").exceptAll(wide).count() == 0
    want = {}
    for r in wide.orderBy("p", "i").collect():
        last = want.setdefault(r.p, [])
        last.append(r.v)
    starts = {(p, k) for p, v in want.items() for k in range(len(v)) if k == 0 or v[k] != v[k - 1]}
    assert {(r.p, r.start) for r in runs.encode(wide, ["p"], ["i"], "v").collect()} == starts
    assert runs.invalid(coded, ["p"]).count() == 0 and runs.invalid(coded.where("start > 0"), ["p"]).count() == 1


def test_classifier(spark):
    df = spark.createDataFrame([(x,) for x in ("川辺", "竹林", "山地の森林", "建物の中", "ほか")], "label string")
    got = {r.label: (r.classes, r.pending) for r in labels.classify(df).collect()}
    assert got["川辺"][0] == [] and got["竹林"][0] == [11] and got["山地の森林"][0] == [6, 7, 8, 9]
    assert got["建物の中"] == ([], [labels.P_INDOOR]) and got["ほか"] == ([], [labels.P_NONE])


def test_spatial_rules(spark):
    df = spark.createDataFrame([(x,) for x in ("河川敷", "河口", "海岸~低山地の森林", "海岸", "水田の畦", "低山地の草地")], "label string")
    got = {r.label: r for r in labels.spatial_rules(df).collect()}
    assert got["河川敷"].classes == [5] and got["河川敷"].river and got["河川敷"].proxy
    assert not got["河口"].supported and got["河口"].classes == []
    assert got["海岸~低山地の森林"].elevation == [0, 1] and not got["海岸~低山地の森林"].coast
    assert got["海岸"].coast and got["海岸"].classes == list(labels.LAND)
    assert got["海岸~低山地の森林"].limitations == [labels.L_HEIGHT, labels.L_RANGE] and got["海岸"].limitations == [] and not got["海岸"].proxy
    assert got["水田の畦"].rice and got["水田の畦"].classes == [5] and got["低山地の草地"].elevation == [1]


def test_names(spark):
    df = spark.createDataFrame([("Araneus  ventricosus (L. Koch, 1878)",), ("Araneus alba minor Bös.",), ("Araneus alba van Hasselt",), ("ｎｏ name",)], "s string")
    got = [r[0] for r in df.select(text.scientific_key(text.norm(F.col("s")))).collect()]
    assert got == ["Araneus ventricosus", "Araneus alba minor", "Araneus alba", "no name"]


def test_capacity_and_restore(spark):
    s = spark.createDataFrame([(1, "B"), (2, "A"), (3, "A"), (4, "")], "species_id long, genus string")
    assert tuple(catalog.genus_capacity(s).first()) == ("A", 2)
    assert tuple(catalog.genus_capacity(s.where("genus = ''")).first()) == ("", 1)
    order = lambda n: [r.species_id for r in catalog.restored("2,1,2,unknown,<script>,3", s, n).orderBy("pos").collect()]
    assert order(3) == [2, 1, 3] and order(2) == [2, 1]


def test_polygons(spark):
    square = [(1, 0.0, 0.0, 4.0, 0.0), (1, 4.0, 0.0, 4.0, 4.0), (1, 4.0, 4.0, 0.0, 4.0), (1, 0.0, 4.0, 0.0, 0.0)]
    edges = spark.createDataFrame(square + [(2, a + 2, b, c + 2, d) for _, a, b, c, d in square], "poly long, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 1.0), (3, 9.0, 1.0)], "id long, px double, py double")
    hits = geometry.inside(points, edges, 1.5)
    assert sorted((r.id, r.poly) for r in hits.collect()) == [(1, 1), (2, 1), (2, 2)]
    assert [(r.id, r.poly) for r in geometry.exactly_one(hits, ["id"]).collect()] == [(1, 1)]


def test_features_close_their_rings(spark):
    e = spark.createDataFrame([(1, 12000, 15000, 1, 3)], "species_id long, gx long, gy long, pref long, matching long")
    ring = json.loads(mapview.features(e).first().feature)["geometry"]["coordinates"][0]
    assert len(ring) == 5 and ring[0] == ring[-1] and ring[1][0] > ring[0][0] and ring[2][1] > ring[1][1]
    with pytest.raises(ValueError):
        mapview.features(e, 0)


def test_planner():
    assert [planner.map_source(*x) for x in ((9, 3, False), (9, 3, True), (12, 3, False), (12, 25, False))] == ["coarse", "detail", "detail", "coarse"]
    assert planner.partitions(list(range(9))) is None and planner.partitions([2, 1, 2]) == [1, 2]
    assert planner.pack_choice([5, 5], 10) == "full" and planner.summary_source("recorded", "all", None) == "recorded"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿name,note\nx,\"a,\nb\"\n", encoding="utf8")
    r = tables.read_csv(spark, str(tmp_path / "a.csv"))
    assert r.columns == ["name", "note"] and r.first().note == "a,\nb"
    (tmp_path / "d.json").write_text(json.dumps({"columns": ["a", "b"], "dictionaries": {"b": ["p", "q"]}, "rows": [["7", 1], ["8", 0]]}))
    assert [(x.a, x.b) for x in tables.read_dictionary_json(spark, str(tmp_path / "d.json")).orderBy("pos").collect()] == [("7", "q"), ("8", "p")]
    data = gzip.compress(b"{}", mtime=0)
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "p.json.gz").write_bytes(data)
    digest = {"p.json.gz": hashlib.sha256(data).hexdigest()}
    assert [tuple(x) for x in tables.verified(spark, str(tmp_path / "z"), digest).collect()] == [("p.json.gz", "{}")]
    for limits in ({"inflated": 1}, {"limit": 3}):
        with pytest.raises(Exception, match="too large|differs"):
            tables.verified(spark, str(tmp_path / "z"), digest, **limits).collect()
    with pytest.raises(Exception, match="digest or size"):
        tables.verified(spark, str(tmp_path / "z"), {"p.json.gz": "0"}).collect()
    sinks.write_csv(r, str(tmp_path / "out"))
    body = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert body.startswith(b"\xef\xbb\xbf\"name\",\"note\"\r\n\"x\"")
    many = spark.range(0, 1000, 1, 3).selectExpr("id", "concat('=', id) as f")
    sinks.write_csv(many, str(tmp_path / "many"))
    parts = [p.read_bytes().decode("utf8") for p in sorted((tmp_path / "many").glob("part-*"))]
    assert len(parts) == 3 and all(p.startswith('\ufeff"id","f"\r\n') and p.endswith('"\r\n') for p in parts)
    assert [x for p in parts for x in p.split("\r\n")[1:-1]] == [f'"{i}","\'={i}"' for i in range(1000)]


def test_visible_text(spark):
    pages = ["<p>a  b</p><script>no</script><div>c<br>d</div>", None, "<p title='x > y'>A &lt;b&gt; &amp;amp;</p><!-- <p>no --><pre>x\ty</pre>", "<STYLE>p{}</STYLE >t<li>u</LI>v<scri", "a<b>b</b>c &copy 1 &#10;2<tr/>3"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "page_id long, html string")
    got = [r.text for r in tables.html_text(df).orderBy("page_id").collect()]
    assert got == ["a b\nc\nd", "", "A <b> &amp;\nx y", "t\nu\nv", "abc © 1\n2\n3"]


def test_mesh_files(spark, tmp_path):
    def written(name, *cells, version=3):
        (tmp_path / name).write_text(json.dumps({"version": version, "grid": "third_order", "aggregation": "all_source_pixel_centers_by_prefecture", "cells": cells}))
        return str(tmp_path / name)

    counts = [*range(16)]
    good = tables.read_mesh(spark, written("a.json", ["53394525", [[13, counts]]])).first()
    assert (good.code, good.x, good.y, good.pref, good.counts) == ("53394525", 3175, 4282, 13, counts)
    bad = [written("b.json", ["53394525", [[13, counts]]], version=2), written("c.json", ["53394525", [[13, counts], [14, counts]]]), written("d.json", ["53394525", [[13, counts[1:]]]]), written("e.json", ["53394525", [[13, [-1, *counts[1:]]]]]), written("f.json", ["53394525", [[13, counts]]], ["53394525", [[13, counts]]])]
    for path in bad:
        with pytest.raises(Exception, match="mesh|prefectures|counts"):
            tables.read_mesh(spark, path).collect()


def test_packs_and_manifest(spark, tmp_path):
    c = cells(spark, [(5, 2, {}), (6, 3, {})])
    assert sinks.write_packs(c, str(tmp_path / "p")).count() == 1
    assert spark.read.parquet(str(tmp_path / "p" / "packs")).where("pref = 1").count() == 1


def test_stream(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' event_type union all select timestamp'2024-01-01 02:00:00', 'a'").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").count() == 2


def test_strata_survive_a_round_trip(spark):
    keys = spark.range(0, K.ALT_STRIDE, 977).select(F.col("id").alias("k"))
    dims = K.unpack(F.col("k"))
    assert keys.where(K.pack(**{d: v for d, v in dims.items() if d != "alt"}) != F.col("k")).count() == 0
    assert compiler.bases(spark).where(K.compact_base(K.source_key(F.col("base"))) != F.col("base")).count() == 0


def test_features_are_all_written(spark):
    e = spark.range(mapview.MAX_FEATURES + 5).selectExpr("1L as species_id", "id % 300 as gx", "15000 + id as gy", "1L as pref", "1L as matching")
    assert mapview.features(e).count() == mapview.MAX_FEATURES + 5
    with pytest.raises(ValueError):
        mapview.features(e, mapview.MAX_FEATURES)


def test_species_with_the_same_conditions_share_their_sums(spark):
    """Strata meet one species of those that are alike; names and repeats of rules do not tell species apart, conditions do."""
    fields = "species_id long, rule_id string, class_mask long, base_mask long, water boolean, built boolean, edge boolean, rice boolean, coast boolean, river boolean, veg long, elev_mask long, elev_required boolean, supported boolean"
    rule = lambda s, name, mask, ok=True: (s, name, mask, mask, *[False] * 6, 0, 15, False, ok)
    rules = spark.createDataFrame([rule(s, f"R{s}", 64) for s in range(20, 60)] + [rule(7, "A", 64), rule(7, "B", 64), rule(8, "A", 64), rule(8, "B", 256), rule(9, "A", 64, False)], fields)
    assert {r.species_id: r.first for r in predicate.alike(rules).collect()} == {7: 7, 8: 8, 9: 9} | {s: 7 for s in range(20, 60)}
    cells = spark.createDataFrame([(12000, 15000 + i, i % 2 + 1, c, 0, 0, 0, 0, 0, 0, 0, 0, n) for i, (c, n) in enumerate([(6, 2), (8, 3), (6, 5), (9, 7)])], "gx long, gy long, pref long, cover long, h long, veg long, wb long, bb long, eb long, rb long, cb long, vb long, n long")
    got = {(r.species_id, r.pref): r.pixels for r in summary.area_by_pref(cells, rules, QuerySettings()).collect()}
    assert got == {(s, 1): 7 for s in (7, 8, *range(20, 60))} | {(8, 2): 3}
    chosen = QuerySettings(habitats={8: ["B"], 7: []})
    got = {(r.species_id, r.pref): r.pixels for r in summary.area_by_pref(cells, rules, chosen).collect()}
    assert got == {(s, 1): 7 for s in range(20, 60)} | {(8, 2): 3}
