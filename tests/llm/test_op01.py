import hashlib
from collections import Counter
from dataclasses import replace

import pytest

from terrabin.llm import anchored as A
from terrabin.llm import op01_suffix_array as op
from terrabin.llm import suffix


def brute(rows):
    docs = [(i, (t or "").encode()) for i, t, *_ in rows]
    key = lambda i: 2**63 - 1 if i is None else i
    least = {}
    for i, t in docs:
        for s in range(len(t) - 49):
            least[t[s : s + 50]] = min(key(i), least.get(t[s : s + 50], key(i)))
    out = Counter()
    for i, t in docs:
        gone = bytearray(len(t))
        for s in range(len(t) - 49):
            if least[t[s : s + 50]] < key(i):
                gone[s : s + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out[(i, len(t), sum(gone), len(gone.split(b"\0")) - gone.split(b"\0").count(b""), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("size", [1 << 24, 3000])
def test_awkward_documents(docs, rows, size):
    got = A.removed(docs, op.TASK, op.report, op.SCHEMA, size).collect()
    assert Counter(tuple(r) for r in got) == brute(rows)


def test_sample_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in op.op1_suffix_array(spark, sf).collect()) == brute(rows)


def test_empty_table(no_docs):
    assert A.removed(no_docs, op.TASK, op.report, op.SCHEMA).count() == 0


def test_interval_tree():
    # banana$: suffixes a, ana, anana, banana, na, nana; maximal repeats a (3), ana (2); na cannot be reported, as a stands before it
    found = suffix.maximal_repeats([0, 1, 3, 0, 0, 2], [ord("n"), ord("n"), ord("b"), -1, ord("a"), ord("a")], [0] * 6)
    assert sorted((n, j - i + 1) for i, j, n, _ in found) == [(1, 3), (3, 2)]


def test_pieces_whose_hashes_agree_in_40_bits(spark):
    # 50 bytes each, of one anchor; the low 40 bits of the first content hash agree within a pair
    tails = ["rGtH", "WGFA", "pLa4", "c1ln", "bO0o", "0XZn", "SjMA", "X1Vp"]
    rows = [(i, "See https://example.org/licence for terms. Id:" + x) for i, x in enumerate(tails)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = A.removed(docs, op.TASK, op.report, op.SCHEMA, 10).collect()
    assert [r.n_removed for r in got] == [0] * 8 and Counter(tuple(r) for r in got) == brute(rows)


@pytest.mark.parametrize("hot", [4096, 3])
def test_one_anchor_with_many_pieces(spark, hot):
    task = replace(op.TASK, hot=hot)
    rows = [(i if i % 11 else None, f"{i % 61:07d} a template that every page has: {i % 53:09d} and {i % 7}, number {i:05d}") for i in range(900)]
    rows += [(2000 + i, rows[7 * i % 900][1][k : k + 50]) for i in range(200) for k in (i % 40,)]  # pieces of one window
    got = A.removed(spark.createDataFrame(rows, "doc_id long, text string"), task, op.report, op.SCHEMA, 4000).collect()
    assert Counter(tuple(r) for r in got) == brute(rows)


def test_anchors_are_the_leftmost_least(spark):
    import numpy as np

    from terrabin.llm import kernels as K

    r = np.random.default_rng(3)
    v = r.integers(0, 40, 500).astype(np.uint64) << np.uint64(50)
    got = K.leftmost_minimum(v, 31)
    assert got.tolist() == [s + int(np.argmin(v[s : s + 31])) for s in range(470)]


def test_many_null_ids(spark):
    docs = spark.range(0, 100_000, 1, 4).selectExpr("cast(null as long) as doc_id", "concat('a text that all the rows here begin with, for long, and then ', id) as text")
    got = A.removed(docs, op.TASK, op.report, op.SCHEMA, 400_000).groupBy("n_removed").count().collect()
    assert [tuple(x) for x in got] == [(0, 100_000)]


def test_block_size_by_rule():
    assert A.X.block_bytes(10**9) == A.X.BLOCK_BYTES and 3e8 < A.X.block_bytes(10**14) < 3.5e8


def test_anchors_spread_over_buckets():
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(1)
    t = pa.table({"doc_id": [1], "text": ["".join(map(chr, r.integers(97, 123, 200_000)))], "block": pa.array([0], pa.int32())})
    sizes = [A.X.unpack(p)[0].shape[1] for p in A.anchors(op.TASK, 8, 40)(t)["payload"].to_pylist()]
    assert len(sizes) == 8 and max(sizes) < 1.2 * min(sizes)
