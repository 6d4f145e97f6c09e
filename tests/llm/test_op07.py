import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import words_of

from terrabin.llm import op07_simhash_cover as op


def fingerprint(text):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words_of(text)]
    shingles = [w[i : i + 4] for i in range(len(w) - 3)] if len(w) >= 4 else [w] if w else []
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(ids_and_prints):
    fps = [f for _, f in ids_and_prints]
    label = list(range(len(fps)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                label[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(ids_and_prints):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [least.get(top(i)) for i in range(len(fps))]


def test_documents(docs, rows):
    want = [(r[0], fingerprint(r[1])) for r in rows]
    got = op.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == Counter((d, f, c) for (d, f), c in zip(want, brute(want), strict=True))


@pytest.mark.parametrize("hot", [op.HOT, 3])
def test_links_lose_nothing(spark, monkeypatch, hot):
    monkeypatch.setattr(op, "HOT", hot)
    r = random.Random(3)
    fps = []
    for _ in range(12):
        f = r.getrandbits(64)
        for _ in range(12):
            fps.append(f)
            for b in r.sample(range(64), r.randint(1, 4)):
                f ^= 1 << b
    pairs = [(i, f) for i, f in enumerate(fps)]
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in pairs], "doc_id long, fp long")
    got = {x.doc_id: x.component_id for x in op.components(df).collect()}
    assert [got[i] for i, _ in pairs] == brute(pairs)


def test_homes_meet_all_within_a_bit():
    r = np.random.default_rng(1)
    fp = r.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64)
    row, anchor, home = op.replicas(fp)
    seen = set(zip(row.tolist(), anchor.tolist(), strict=True))
    for bit in range(64):
        other = fp ^ np.uint64(1 << bit)
        k = next(k for k, (s, w) in enumerate(op.BLOCKS) if s <= bit < s + w)
        orow, oanchor, ohome = op.replicas(other)
        for i, a in zip(orow[ohome].tolist(), oanchor[ohome].tolist(), strict=True):
            assert (i, a) in seen or a >> 22 != k


def test_large_groups_are_forests():
    fp = np.array([1 << i for i in range(40)] + [(1 << i) | (1 << 50) for i in range(40)], np.uint64)
    a, b = op.link(np.zeros(80, np.int64), fp, np.ones(80, bool))
    assert len(a) == 79


def test_empty_table(no_docs):
    assert op.near_duplicates(no_docs).count() == 0
