"""The pipeline's stages against brute-force versions of what each must keep."""

from collections import Counter

import test_op02
import test_op06
import test_op07
from conftest import SCHEMA, awkward_rows

import corpus_pipeline as P
from terrabin.llm import op07_simhash_cover, op10_flow_mix


def tables(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages(spark, tmp_path):
    rows = awkward_rows(2)
    sf = tables(spark, tmp_path / "sf", rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixing", "token_files"]

    good = [r for r in rows if (b := test_op02.brute(r[1]))[0] >= 20 and 100 * b[4] <= 30 * b[0]]
    got = stages["quality_rules"](spark, docs, sf)
    assert got.columns == docs.columns and Counter(tuple(r) for r in got.collect()) == Counter(good)

    got = stages["near_duplicates"](spark, docs, sf)
    prints = [(r[0], test_op07.fingerprint(r[1])) for r in rows]
    component = test_op07.brute(prints)
    kept = [r.doc_id for r in got.collect()]
    assert got.columns == docs.columns and len(kept) == len({c for c in component}) and set(kept) == set(component)

    got = stages["decontamination"](spark, docs, sf)
    items = [(1, " ".join(f"w{i}" for i in range(60)))]
    assert Counter(tuple(r) for r in got.collect()) == Counter(r for r in rows if not next(iter(test_op06.brute([r], items)))[-1])

    got = stages["mixing"](spark, docs, sf)
    assert got.columns == docs.columns and got.count() > 0
    assert set(r.doc_id for r in got.collect()) <= {r[0] for r in rows}

    got = stages["token_files"](spark, docs, sf)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() == len(rows)


def test_run(spark, tmp_path):
    sf = tables(spark, tmp_path / "sf", awkward_rows(5))
    first = sorted(map(tuple, P.run(spark, sf).collect()), key=str)
    assert first and first == sorted(map(tuple, P.run(spark, sf).collect()), key=str)


def test_empty(spark, tmp_path):
    sf = tables(spark, tmp_path / "sf", [])
    assert P.run(spark, sf).count() == 0


def test_large_components_keep_one(spark):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(i, text + f" tail{i}", "en", "s", 1, 1, 1, None) for i in range(200)]
    assert op07_simhash_cover.filtered(spark.createDataFrame(rows, SCHEMA)).count() == 1
    assert op10_flow_mix.by_source(spark.createDataFrame(rows, SCHEMA)).count() == 200
