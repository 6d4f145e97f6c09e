import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from terrabin.llm import op11_vector_codes as op

SCHEMA = "vec_id long, embedding array<float>, label int, code string, part int, error long"


def brute(rows):
    """(vec_id, code, error, label_error, digest) of (vec_id, vector, label), in plain integers."""
    rows = [(i, [float(x) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(v) for _, v, _ in rows), default=0) // 8) * 8
    whole = [[min(max(math.floor(op.SCALE * x), -op.LIMIT), op.LIMIT) for x in v] + [0] * (width - len(v)) for _, v, _ in rows]
    p = width // 8
    cut = [[w[j * p : (j + 1) * p] for j in range(8)] for w in whole]
    books = [[c[j] for c in cut[:16]] for j in range(8)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min((dist(c[j], b), e) for e, b in enumerate(books[j])) for j in range(8)] for c in cut]

    for _ in range(6):
        near = assign()
        for j in range(8):
            for e in range(len(books[j])):
                mine = [c[j] for c, n in zip(cut, near) if n[j][1] == e]
                if mine:
                    books[j][e] = [sum(x) // len(mine) for x in zip(*mine)]
    near = assign() if rows else []
    digest = hashlib.sha256(",".join(str(x) for j in books for e in j for x in e).encode()).hexdigest()
    errors = [min(sum(d for d, _ in n), op.MOST) for n in near]
    total = {}
    for (_, _, l), e in zip(rows, errors):
        total[l] = total.get(l, 0) + e
    return sorted(((i, "".join(f"{e:02x}" for _, e in n), e_, min(total[l], op.MOST), digest) for (i, _, l), n, e_ in zip(rows, near, errors)), key=repr)


def result(df):
    rows, books = op.compress(df)
    return sorted(((r.vec_id, r.code, r.error, r.label_error, op.digest(books)) for r in op.with_label_error(rows).collect()), key=repr)


def vectors(n, seed, width=24, scale=1.0):
    r = random.Random(seed)
    f = lambda x: float(np.float32(x))
    return [(r.choice([i, i, i, 7, None]) if i > 20 else i, [f(r.gauss(0, scale)) for _ in range(width)], r.choice([1, 2, None])) for i in range(n)]


@pytest.mark.parametrize("case", ["plain", "few", "ragged", "large", "awkward"])
def test_equals_plain_integers(spark, case):
    rows = vectors(9 if case == "few" else 150, 3, scale=1e6 if case == "large" else 1.0)
    if case == "large":
        rows += [(500, [3e38] + [0.0] * 23, 1), (501, [-3e38] * 24, 1)]
    if case == "ragged":
        rows += [(900, [1.0] * 19, 1), (901, [], 2), (902, [0.5], None)]
    if case == "awkward":
        rows += [(600, None, 1), (601, [None] + [1.0] * 23, 1), (602, [math.nan] * 24, 2), (603, [math.inf] + [0.0] * 23, None), rows[0], rows[0], rows[30]]
        rows += [(700 + i, rows[5][1], 9) for i in range(60)]  # ties between entries and a group of equal vectors
    df = spark.createDataFrame([(*r, None, 3, None) for r in rows], SCHEMA).repartition(5)
    assert result(df) == brute(rows)


def test_hot_and_rare_labels_meet_their_totals(spark, monkeypatch):
    monkeypatch.setattr(op, "HOT_SHARE", 0.2)
    rows = [(i, v, None if i % 3 == 0 else i % 7) for i, (_, v, _) in enumerate(vectors(90, 5, 8))]
    assert result(spark.createDataFrame([(*r, None, 3, None) for r in rows], SCHEMA)) == brute(rows)


def test_sums_are_flushed(spark, monkeypatch):
    monkeypatch.setattr(op, "FLUSH_ROWS", 16)
    rows = vectors(150, 4)
    assert result(spark.createDataFrame([(*r, None, 3, None) for r in rows], SCHEMA).coalesce(1)) == brute(rows)


def test_empty(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []
    assert result(spark.createDataFrame([(1, None, 1, None, 1, None)], SCHEMA)) == []
    rows = [(1, [], 1), (2, [], None)]
    assert result(spark.createDataFrame([(*r, None, 3, None) for r in rows], SCHEMA)) == brute(rows)


def test_codes_decode(spark):
    rows, books = op.compress(spark.createDataFrame([(*r, None, 3, None) for r in vectors(60, 8)], SCHEMA))
    r = rows.where("vec_id = 3").first()
    whole = np.floor(np.array(vectors(60, 8)[3][1]) * op.SCALE)
    assert ((op.decoded(r.code, books) - whole) ** 2).sum() == r.error


def test_query_equals_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
    df = op.op11_vector_codes(spark, sf)
    want = duck.execute(op.SQL)
    at = [[d[0] for d in want.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
