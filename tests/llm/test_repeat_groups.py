from collections import defaultdict

import pytest
from conftest import SCHEMA

from terrabin.llm import op01_suffix_array as op


@pytest.mark.parametrize("size", [1 << 24, 3000])
def test_groups_hold_all_occurrences(spark, rows, size):
    texts = [(r[1] or "").encode() for r in rows]
    docs = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    groups = defaultdict(set)
    for r in op.groups(docs, block_bytes=size).collect():
        assert (r.doc_id, r.start, r.length) not in groups[r.group]
        groups[r.group].add((r.doc_id, r.start, r.length))
    at = defaultdict(set)  # the groups of each window, with the places at which they hold it
    for g, held in groups.items():
        assert len(held) > 1 and len({texts[d][s : s + n] for d, s, n in held}) == 1
        n = next(iter(held))[2]
        for k in range(n - 49):
            places = frozenset((d, s + k) for d, s, _ in held)
            d, s = next(iter(places))
            at[texts[d][s : s + 50]].add(places)
    windows = defaultdict(set)
    for d, t in enumerate(texts):
        for s in range(len(t) - 49):
            windows[t[s : s + 50]].add((d, s))
    repeated = {w: p for w, p in windows.items() if len(p) > 1}
    assert repeated.keys() == at.keys()
    assert all(frozenset(p) in at[w] for w, p in repeated.items())


def test_empty_table(no_docs):
    assert op.groups(no_docs).count() == 0
