import hashlib
import random
import zlib

import duckdb
import pytest

from terrabin.llm import op13_merkle_manifest as op


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(i, source, lang, n, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        run = i // 16 * 16
        out.append((level[run:i], level[i + 1 : run + 16]))
        i //= 16
    return out


def brute(rows):
    """Rows (doc_id, text, lang, source, n_chars) to the query's, by whole trees in memory."""
    by = {}
    for i, text, lang, source, n in rows:
        other = None
        if i is not None and zlib.crc32(str(i).encode()) % 5 == 0:
            other = leaf_of(i, source, lang, n, text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        by.setdefault(source, []).append((i, leaf_of(i, source, lang, n, text), other))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {s: levels([r[1] for r in by[s]]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    root, out = top[-1][0], []
    for k, s in enumerate(order):
        for j, (i, leaf, other) in enumerate(by[s]):
            path = siblings(trees[s], j) + siblings(top, k)
            fold = other or leaf
            for before, after in path:
                fold = H(*before, fold, *after)
            out.append((i, leaf, trees[s][-1][0], root, H(*(h for b, a in path for h in b + a)), fold, fold == root))
    return sorted(out, key=repr)


def result(docs):
    return sorted(map(tuple, op.proofs(op.manifest(op.leaves(docs, op.lowered_every_fifth()))).collect()), key=repr)


@pytest.mark.parametrize("fan,ranges", [(32, 1 << 15), (2, 1), (3, 40)])
def test_equals_whole_trees(spark, docs, rows, monkeypatch, fan, ranges):
    monkeypatch.setattr(op, "FAN", fan)
    monkeypatch.setattr(op, "RANGE_ROWS", ranges)
    assert result(docs) == brute([r[:5] for r in rows])


@pytest.mark.parametrize("case", ["hot", "many sources", "equal rows", "one"])
def test_shapes_of_trees(spark, monkeypatch, case):
    monkeypatch.setattr(op, "FAN", 2)
    monkeypatch.setattr(op, "RANGE_ROWS", 1)
    r = random.Random(case)
    source = {"hot": lambda i: r.choice(["a", "a", "b", None, "é", "Z"]), "many sources": lambda i: f"s{r.randrange(300)}", "equal rows": lambda i: "s", "one": lambda i: None}[case]
    rows = [(i, f"Text {i} É A", "en", source(i), i) for i in range({"one": 1}.get(case, 700))]
    if case == "equal rows":
        rows = [(5, "same Text", "en", "s", 9)] * 400 + rows[:290] + [(None, None, None, "s", None)] * 3
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    m = op.manifest(op.leaves(docs, op.lowered_every_fifth()))
    assert case == "one" or m.place.count() > 4
    assert result(docs) == brute(rows)


def test_merging_is_associative_and_commutative():
    nodes = [(t, i, H(f"{t}.{i}")) for t, n in ((0, 40), (1, 1), (2, 300)) for i in range(n)]
    sizes = {0: 40, 1: 1, 2: 300, op.TOP: 3}

    def forest(some):
        f = op.Forest(sizes)
        for t, lv, i, h in some:
            f.put(t, lv, i, h)
        f.resolve()
        return [(t, lv, i, h) for (t, lv), m in f.open.items() for i, h in m.items()]

    for seed in range(5):
        r = random.Random(seed)
        parts = [[] for _ in range(6)]
        for t, i, h in nodes:
            r.choice(parts).append((t, 0, i, h))
        fragments = [forest(p) for p in parts]
        while len(fragments) > 1:
            a, b = fragments.pop(r.randrange(len(fragments))), fragments.pop(r.randrange(len(fragments)))
            fragments.append(forest(a + b))
        assert [x[:3] for x in fragments[0]] == [(op.TOP, 1, 0)]
        top = levels([levels([h for t, _, h in nodes if t == k])[-1][0] for k in range(3)])
        assert fragments[0][0][3] == top[-1][0]


def test_tampering_is_found(spark, docs, rows):
    got = op.proofs(op.manifest(op.leaves(docs, op.lowered_every_fifth()))).collect()
    texts = {r[0]: r[1] for r in rows if sum(x[0] == r[0] for x in rows) == 1}
    for r in got:
        if r.doc_id in texts:
            changed = zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in texts[r.doc_id] or "")
            assert r.verified == (not changed) == (r.folded_root == r.root)
    assert not all(r.verified for r in got)


def test_long_text_and_no_documents(spark, no_docs):
    rows = [(i, "Ab " * 3_000_000 if i == 3 else "x", "en", "s", 1) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert result(docs) == brute(rows)
    assert op.manifest(op.leaves(no_docs)).root is None and result(no_docs) == []


def test_query_equals_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    df = op.op13_merkle_manifest(spark, sf)
    want = duck.execute(op.SQL)
    at = [[d[0] for d in want.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
