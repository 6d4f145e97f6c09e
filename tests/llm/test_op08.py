import math
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import words_of

from terrabin.llm import op08_deleted_interpolation as op


def test_base_score_and_counts(docs, rows):
    def toks(t):
        return [*(w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in words_of(t)), 0]

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for r in rows if not held(r[0]) for w in toks(r[1]))
    n, v = sum(c.values()), len(c)
    want = Counter((r[0], held(r[0]), len(toks(r[1])), sum(c[w] > 0 for w in toks(r[1])), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(r[1])), 6)) for r in rows)
    got = op.scored(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score <= 0 for r in got)


def test_model_beats_the_unigram_base_on_held_out_text(spark, sf):
    r = op.op8_deleted_interpolation(spark, sf).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert r["sum(score)"] > r["sum(base_score)"]


def lower(t):
    return [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in words_of(t)]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def counts(rows):
    """Of words and pairs in training; None is the end, and the start as a context."""
    one, two = Counter(), Counter()
    for i, t, *_ in rows:
        if not held(i):
            w = [None, *lower(t), None]
            one.update(w[1:])
            two.update(zip(w, w[1:], strict=False))
    return one, two


def test_score_equals_a_plain_model(docs, rows):
    _, m = op.counted(docs)
    one, two = counts(rows)
    assert (m.tokens, m.vocabulary) == (sum(one.values()), len(one))
    want = Counter()
    for i, t, *_ in rows:
        w, total = [None, *lower(t), None], 0.0
        for a, b in zip(w, w[1:], strict=False):
            k = m.weights[0 if not one[a] else min(1 + int(math.log2(one[a])), op.BUCKETS - 1)]
            total += math.log10((k[0] * two[a, b] / one[a] if one[a] else 0) + k[1] * one[b] / m.tokens + k[2] / (m.vocabulary + 1))
        want[(i, round(total, 6))] += 1
    assert Counter((r.doc_id, round(r.score, 6)) for r in op.scored(docs).collect()) == want


def plain_em(rows, m):
    """Weights by EM over the tokens of the deleted fold, with the counts of the other training documents."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 7 if i is not None else None
    one, two = counts([r for r in rows if fold(r[0]) != 0])
    n = sum(one.values())
    seen = Counter()
    for i, t, *_ in rows:
        if fold(i) == 0:
            w = [None, *lower(t), None]
            for a, b in zip(w, w[1:], strict=False):
                h, hw, u = one[a], two[a, b], one[b]
                q = lambda p: 2 ** (round(4 * math.log2(p)) / 4) if p else 0
                seen[min(1 + int(math.log2(h)), op.BUCKETS - 1) if h else 0, q(hw / max(h, 1)), q(u) / max(n, 1), 1 / (m.vocabulary + 1)] += 1
    weights = [[1 / 3] * 3 for _ in range(op.BUCKETS)]
    for _ in range(op.ROUNDS):
        sums = [[0.1, 0.5, 0.5] for _ in range(op.BUCKETS)]
        for (k, *p), times in seen.items():
            share = [x * y for x, y in zip(weights[k], p, strict=True)]
            for j in range(3):
                sums[k][j] += times * share[j] / sum(share)
        weights = [[x / sum(s) for x in s] for s in sums]
    return weights, seen


def test_weights_equal_plain_em_on_deleted_counts(spark):
    r = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{int(x)}" for x in r.zipf(1.6, 60) if x < 500)) for i in range(150)] + [(None, "w1 w2 w1 w2")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, m = op.counted(docs)
    weights, seen = plain_em(rows, m)
    assert len({k for k, *_ in seen}) > 5
    for k in range(1, op.BUCKETS):
        assert m.weights[k].tolist() == pytest.approx(weights[k], abs=1e-6)
    for size in (3000, 1 << 30):  # how documents are dealt to blocks changes nothing
        assert np.allclose(op.counted(docs, size)[1].weights, m.weights, atol=1e-12)


def test_weights_are_learned_from_the_smallest_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    _, m = op.counted(docs)
    weights, seen = plain_em([tuple(r) for r in docs.select("doc_id", "text").collect()], m)
    used = {k for k, *_ in seen} - {0}
    assert all(m.weights[k].tolist() == pytest.approx(weights[k], abs=1e-6) for k in used)
    prior = [0.1 / 1.1, 0.5 / 1.1, 0.5 / 1.1]
    assert sum(abs(m.weights[k] - prior).max() > 0.05 for k in used) >= 0.8 * len(used)


def test_probabilities_of_a_context_sum_to_one(docs, rows):
    _, m = op.counted(docs)
    one, two = counts(rows)
    names = [*one, "a word never seen"]  # the vocabulary and one unknown word
    for a in list(one)[:30]:
        h, hw, w = (np.array(x, float) for x in ([one[a]] * len(names), [two[a, b] for b in names], [one[b] for b in names]))
        assert (10 ** m.log10(h, hw, w)).sum() == pytest.approx(1)


def test_empty_table(no_docs):
    assert op.scored(no_docs).count() == 0
