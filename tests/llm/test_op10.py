import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from terrabin.llm import op10_flow_mix as op


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute_targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    out, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit > most * sizes[s]]
        if not full:
            return out | {s: weight[s] * unit for s in open_}
        for s in full:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
            open_.discard(s)
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 300}, {f"s{i}": 7**(i % 9) for i in range(57)}, {"x": 0, "y": 0}, {"x": 0, "y": 5}])
def test_targets_by_plain_refilling(spark, sizes):
    got = {r.source: r for r in op.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    assert {s: r.target for s, r in got.items()} == pytest.approx({s: float(t) for s, t in brute_targets(sizes).items()})
    assert {s: r.source_size for s, r in got.items()} == sizes
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert [got[s].rank for s in names] == list(range(len(names)))


def test_flow_serves_overlapping_sources():
    patterns = {("a",): 100, ("a", "b"): 50, ("b",): 10}
    given = op.flow(patterns, {"a": 120, "b": 60})
    assert sum(given.values()) == 180 and all(given.get(p, 0) <= 2 * n for p, n in patterns.items())
    assert sum(max(0, given[p] - n) for p, n in patterns.items()) == 20  # all 160 words once, and 20 again: no more repeats than needed


def test_documents(docs, rows):
    got = op.by_source(docs).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r[0], r[3], size(r[1])) for r in rows)
    total, target, sizes = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    for r in got:
        assert r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        total[r.source] += r.taken
        target[r.source] = r.target
    want = brute_targets(dict(sizes))
    for s in sizes:
        assert target[s] == float(want[s])
        assert abs(total[s] - target[s]) <= 1
    key = lambda r: (str(r.doc_id), r.size, r.taken, str(r.source))
    assert sorted(map(key, got)) == sorted(map(key, op.by_source(docs.repartition(5)).collect()))


def test_mix_itself_repeats_and_cuts(docs):
    taken = defaultdict(int)
    for r in op.by_source(docs).collect():
        taken[r.source] += r.taken
    out = op.repeated(docs)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.source] += size(r.text)
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in taken.items() if n}


def test_empty_table(no_docs):
    assert op.by_source(no_docs).count() == 0 and op.mixed(no_docs.selectExpr('*', 'array(source, lang) as m'), 'm')[0].count() == 0 and op.repeated(no_docs).count() == 0


def test_equal_rows_share_the_rest(spark):
    rows = [(1, " ".join(f"w{k}" for k in range(10)), "s")] * 10 + [(2, "a b c", "t")] * 3
    got = op.by_source(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    total = {s: sum(r.taken for r in got if r.source == s) for s in "st"}
    target = {r.source: r.target for r in got}
    assert all(target[s] - 10 <= total[s] <= target[s] + 1 for s in "st") and all(r.taken <= 2 * r.size for r in got)


def test_overlap_from_documents_to_taken(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 4)), m) for i, m in enumerate([["a"], ["a", "b"], ["b"], ["a"], ["a"], ["c"], None, ["d", "b", "a"], ["e", "f"], ["f"]] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m array<string>")
    out, goals = op.mixed(docs, "m")
    got, quota = out.collect(), {r.source: r.quota for r in goals.collect()}
    patterns, took = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.taken <= 2 * r.size
        patterns[tuple(r.sources)] += r.size
        took[tuple(r.sources)] += r.taken
    sizes = defaultdict(int)
    for p, n in patterns.items():
        for s in p:
            sizes[s] += n
    assert {r.source: r.target for r in goals.collect()} == pytest.approx({s: float(t) for s, t in brute_targets(sizes).items()})
    want = op.flow(dict(patterns), quota)  # all components in one flow
    assert sum(want.values()) == best(patterns, quota)
    assert all(abs(took[p] - want[p]) <= 1 + want[p] / op.SLACK for p in patterns) or abs(sum(took.values()) - sum(want.values())) <= len(want)
    assert sorted(map(str, got)) == sorted(map(str, op.mixed(docs.repartition(5), "m")[0].collect()))


def best(patterns, quotas):
    """The largest flow, as the least cut over all sets of sources."""
    names = sorted(quotas, key=str)
    return min(
        sum(quotas[s] for k, s in enumerate(names) if bits >> k & 1) + sum(2 * n for p, n in patterns.items() if any(not bits >> names.index(s) & 1 for s in p)) for bits in range(1 << len(names))
    )


def test_joins_without_broadcast_give_the_same(spark, docs, monkeypatch):
    one = sorted(map(str, op.by_source(docs).collect()))
    monkeypatch.setattr(op, "BROADCAST_BYTES", 0)
    assert sorted(map(str, op.by_source(docs).collect())) == one
