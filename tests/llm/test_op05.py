import hashlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from conftest import words_of

from terrabin.llm import anchored as A
from terrabin.llm import fm_index
from terrabin.llm import kernels as K
from terrabin.llm import op05_fm_index as op


def brute(rows):
    docs = [(i, words_of(t)) for i, t, *_ in rows]
    held = Counter(tuple(w[s : s + 35]) for _, w in docs for s in range(len(w) - 34))
    out = Counter()
    for i, w in docs:
        gone = [False] * len(w)
        for s in range(len(w) - 34):
            if held[tuple(w[s : s + 35])] > 1:
                gone[s : s + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[(i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("size", [1 << 24, 3000])
def test_awkward_documents(docs, rows, size):
    got = A.removed(docs, op.TASK, op.report, op.SCHEMA, size).collect()
    assert Counter(tuple(r) for r in got) == brute(rows)


def test_sample_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in op.op5_fm_index(spark, sf).collect()) == brute(rows)


def test_empty_table(no_docs):
    assert A.removed(no_docs, op.TASK, op.report, op.SCHEMA).count() == 0


def test_counts_equal_a_plain_search():
    r = np.random.default_rng(5)
    pieces = [r.integers(0, 3, r.integers(1, 30)) for _ in range(20)]
    ends = np.cumsum([len(p) for p in pieces])
    index = fm_index.FMIndex(np.concatenate(pieces), ends, 8)
    for _ in range(200):
        pattern = r.integers(0, 3, r.integers(1, 8))
        lo, hi = np.array([0]), np.array([index.n])
        for c in pattern[::-1]:
            lo, hi = index.step(np.array([c + 1]), lo, hi)
        want = sum((p[s : s + len(pattern)] == pattern).all() for p in pieces for s in range(len(p) - len(pattern) + 1))
        assert hi[0] - lo[0] == want


def test_pieces_whose_hashes_agree_in_40_bits(spark):
    # 35 words each, of one anchor; the low 40 bits of the first content hash agree within a pair
    tails = ["x3428209", "x3622608", "x0132596", "x2485662", "x3052752", "x3774119", "x3234641", "x1239785"]
    rows = [(i, " ".join([*(f"w{k}" for k in range(34)), x])) for i, x in enumerate(tails)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = A.removed(docs, op.TASK, op.report, op.SCHEMA, 10).collect()
    assert [r.n_removed for r in got] == [0] * 8 and Counter(tuple(r) for r in got) == brute(rows)


def test_pairs_are_grouped_by_both():
    a, b = np.array([5, 3, 5, 5, 3], np.uint64), np.array([1, 2, 9, 1, 2], np.uint64)
    at, first = K.pair_groups(a, b)
    assert sorted(sorted(g.tolist()) for g in np.split(at, first[1:])) == [[0, 3], [1, 4], [2]]


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics_equal_a_plain_search(seed):
    r = np.random.default_rng(seed)
    pieces = [r.integers(0, 2 + seed % 3, r.integers(1, 40)) for _ in range(25)]
    pieces += [p[a:] for p in pieces[:6] for a in (0, 2)]
    copies = r.integers(1, 3, len(pieces))
    ends = np.cumsum([len(p) for p in pieces])
    starts = np.concatenate([[0], ends[:-1]])
    depth = int(r.integers(1, 12))
    index = fm_index.FMIndex(np.concatenate(pieces), ends, depth)
    index.weigh(copies)
    got = fm_index.matching_statistics(index, index.coded, starts, ends, depth)
    held = Counter()
    for p, c in zip(pieces, copies, strict=True):
        for s in range(len(p)):
            for n in range(1, min(depth, len(p) - s) + 1):
                held[tuple(p[s : s + n].tolist())] += int(c)
    want = [max([n for n in range(1, min(depth, len(p) - s) + 1) if held[tuple(p[s : s + n].tolist())] > 1], default=0) for p in pieces for s in range(len(p))]
    assert got.tolist() == want


@pytest.mark.parametrize("hot", [4096, 2])
def test_one_anchor_with_many_pieces(spark, hot):
    task = replace(op.TASK, hot=hot)
    fixed = " ".join(f"the{k}" for k in range(20))
    rows = [(i, f"{' '.join(f'a{i % 97}x{k}' for k in range(18))} {fixed} {' '.join(f'b{i % 89}x{k}' for k in range(18))}") for i in range(400)]
    got = A.removed(spark.createDataFrame(rows, "doc_id long, text string"), task, op.report, op.SCHEMA, 2000).collect()
    assert Counter(tuple(r) for r in got) == brute(rows)


def test_many_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.range(0, 100_000, 1, 4).selectExpr("cast(null as long) as doc_id", f"if(id % 50000 = 7, '{text}', concat('short ', id)) as text")
    got = A.removed(docs, op.TASK, op.report, op.SCHEMA, 200_000).groupBy("n_words", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(2, 0, 99_998), (40, 40, 2)]
    blocked, n, _ = A.X.blocks(docs, 200_000)
    sizes = [r["count"] for r in blocked.groupBy("block").count().collect()]
    assert len(sizes) == n > 5 and max(sizes) < 2 * 100_000 / n
