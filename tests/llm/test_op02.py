import re
from collections import Counter

import numpy as np
import pytest
from conftest import words_of
from pyspark.sql import functions as F

from terrabin.llm import op02_decision_list as op


def brute(text):
    t = text or ""
    w = words_of(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_base_statistics(docs, rows):
    got = op.judged(docs, op.DecisionList(), ["doc_id"]).collect()
    assert Counter((r.row.doc_id, *(r[c] for c in op.BASE)) for r in got) == Counter((r[0], *brute(r[1])) for r in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept == (not r.base_failed)


def test_rows_pass_unchanged(docs, rows):
    kept = op.filtered(docs, op.DecisionList())
    assert kept.columns == docs.columns
    want = Counter(tuple(r) for r in rows if brute(r[1])[0] >= 20 and 100 * brute(r[1])[4] <= 30 * brute(r[1])[0])
    assert Counter(tuple(r) for r in kept.collect()) == want


def labelled(spark, n=600):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = list(rng.choice(vocabulary, 60))
        bad = i % 5
        if bad == 0:
            words = [w + "##" if k % 2 else w for k, w in enumerate(words)]
        elif bad == 1:
            words[rng.integers(60)] = "Nasty,"
            words[rng.integers(60)] = "nasty"
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad != 0), int(bad == 1)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_list_is_learned_and_holds_out(spark):
    docs, labels = labelled(spark)
    model = op.fit(docs.where("doc_id < 450"), labels)
    assert "nasty" in model.cues and model.rules
    got = op.judged(docs.where("doc_id >= 450"), model).join(labels.withColumnRenamed("doc_id", "i"), F.col("row.doc_id") == F.col("i"))
    wrong = got.where(F.col("kept") != ((F.col("quality") == 1) & (F.col("toxic") == 0))).count()
    assert wrong <= 3


def test_expression_equals_the_rules_in_order(spark):
    model = op.DecisionList((op.Rule((("n_words", ">", 50.0), ("symbol_ratio", "<=", 0.0))), op.Rule((("n_words", ">", 10.0),))))
    df = spark.createDataFrame([("a " * 60, 0), ("# " * 60, 1), ("a", None)], "text string, want int").withColumn("doc_id", F.lit(1))
    assert [r.rule for r in op.judged(df, model).orderBy("row.want").collect()] == [None, 0, 1]


def test_without_labels_or_rows(docs, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op.fit(docs, none) == op.DecisionList() and op.filtered(no_docs, op.DecisionList()).count() == 0


@pytest.mark.parametrize("bad", [0, 1])
def test_one_class_only(bad):
    x = {f: np.arange(40.0) for f in op.FEATURES}
    rules = op.learn(x, np.full(40, bool(bad)), np.arange(40) % 3 != 0)
    assert len(rules) <= 1


def test_rows_of_a_repeated_labelled_id_count_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 3, f"word{i} " * (30 + i)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(op, "_train", lambda sample: seen.append(sample) or [])
    op.fit(docs, labels)
    assert seen[0]["doc_id"].tolist() == [0, 1, 2] and seen[0]["bad"].tolist() == [False, True, True]


def test_cue_words_come_from_the_growing_rows_alone(spark, monkeypatch):
    ids = spark.range(400).selectExpr("id", "pmod(xxhash64(3, id), 3) <> 0 as grow").collect()
    docs = spark.createDataFrame([(r.id, " ".join(f"c{k} {'growing' if r.grow else 'pruning'}" for k in range(15))) for r in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(r.id, 0, 0) for r in ids], "doc_id long, quality int, toxic int")
    cues = op.fit(docs, labels).cues
    assert "pruning" not in cues
