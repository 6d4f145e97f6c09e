import hashlib
import re
from collections import Counter

import pytest

from terrabin.llm import op06_decontaminate as op

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(rows, items):
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[s : s + n]), set()).update({str(i)} if i is not None else set())
    out = Counter()
    for d, t, *_ in rows:
        w, hit, who = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for s in range(len(w) - n + 1):
                if (g := tuple(w[s : s + n])) in grams:
                    hit.update(range(s, s + n))
                    who |= grams[g]
        out[(d, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))] += 1
    return out


@pytest.fixture(scope="module")
def items(rows):
    long = next(t for _, t, *_ in rows if t and t.startswith("long"))
    passage = " ".join(f"W{i}" for i in range(60))
    return [(1, passage), (2, "One, two; THREE!"), (10, " ".join(long.split()[500:530])), (3, None), (4, "..."), (None, " ".join(long.split()[40:60])), (5, passage)]


@pytest.mark.parametrize("limit", [1 << 20, 300])
def test_documents(spark, docs, rows, items, limit):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = op.digest(op.hits(docs, bench, ["doc_id"], limit=limit)).collect()
    assert Counter(tuple(r) for r in got) == brute(rows, items)


def test_rows_pass_or_go(spark, docs, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for r in rows:
        bad = next(iter(brute([r], items)))[-1]
        want[r] += not bad
    assert Counter(tuple(r) for r in op.filtered(docs, bench).collect()) == +want


def test_spans_are_cut(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    df = spark.createDataFrame([(1, "é zero, One two: three four"), (2, None)], "doc_id long, text string")
    assert [r.text for r in op.without_spans(df, bench).orderBy("doc_id").collect()] == ["é zero,  four", None]


def test_empty_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert op.digest(op.hits(docs, none)).where("n_hit > 0").count() == 0
    assert op.digest(op.hits(no_docs, none)).count() == 0


def test_equal_and_hot_items(spark):
    rows = [(i, "the cat sat on the mat " * 30 + f"tail {i}") for i in range(20)] + [(99, "nothing here")]
    items = [(i, "the") for i in range(300)] + [(i, "On the MAT, the cat") for i in range(300, 330)] + [(7, "the")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 20, 400):
        got = op.digest(op.hits(docs, bench, ["doc_id"], limit=limit)).collect()
        assert Counter(tuple(r) for r in got) == brute(rows, items)


def test_parts_are_cut_by_measured_size(spark):
    bench = spark.createDataFrame([(i, f"word{i % 5} " * 50) for i in range(200)] + [(999, "x" * 5000)], "item_id long, text string")
    items, parts = op.dealt(bench, 2000)
    sizes = {r["bucket"]: r["n"] for r in items.selectExpr("bucket", "octet_length(text) as n").groupBy("bucket").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert sorted(b for p in parts for b in p) == sorted(sizes) and all(len(p) == 1 or sum(sizes[b] for b in p) <= 2000 for p in parts)


def test_size_of_a_set():
    import random

    r = random.Random(1)
    items = [(i, " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(200))) for i in range(800)]
    text = sum(len(t) for _, t in items)
    assert op.WindowSet(items).nbytes() < 7 * text


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(op.K, "mix", lambda x: x & op.K.U64(3) | (x << op.K.U64(62)))
    words_ = [f"w{i}" for i in range(40)]
    known = op.WindowSet([(i, w) for i, w in enumerate(words_[:20])])
    import numpy as np

    raw = np.frombuffer(" ".join(words_).encode(), np.uint8)
    gone, _, item = known.hits(op.Words(raw, np.array([0, len(raw)])))
    assert gone.tolist() == [k < 20 for k in range(40)] and sorted(known.names[i] for i in item) == sorted(str(i) for i in range(20))
