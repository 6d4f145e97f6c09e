import hashlib
import random
import re

from conftest import SCHEMA

from terrabin.llm import op03_line_deletions as op


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= 1


def brute(spark, rows):
    hashes = {t: h for t, h in spark.createDataFrame([(r[1],) for r in rows], "t string").selectExpr("t", "xxhash64(t)").distinct().collect()}
    first, lines = {}, []
    for d, t, *_ in rows:
        for p, x in enumerate((t or "").split("\n") if t is not None else []):
            if re.search(r"[^\x20\x09-\x0D]", x):
                place = (op.NO_ID if d is None else d, hashes[t], p)
                lines.append((place, x))
                first[x] = min(place, first.get(x, place))
    near = {a for a in first for b in first if first[b] < first[a] and a != b and within_one(a, b)}
    out = []
    for d, t, *_ in rows:
        parts = (t or "").split("\n")
        place = lambda p, d=d, t=t: (op.NO_ID if d is None else d, hashes[t], p)
        word = [bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in parts]
        gone = [w and (x in near or place(p) != first[x]) for p, (x, w) in enumerate(zip(parts, word, strict=True))]
        n_near = sum(g and place(p) == first[x] for p, (x, g) in enumerate(zip(parts, gone, strict=True)))
        kept = "\n".join(x for x, g in zip(parts, gone, strict=True) if not g)
        out.append((d, sum(word), sum(gone), n_near, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    df = op.deduplicated(spark.createDataFrame(rows, SCHEMA).repartition(3))
    return sorted(((r.doc_id, r.n_lines, r.n_removed, r.n_near, hashlib.sha256(r.kept.encode()).hexdigest()) for r in df.collect()), key=str)


def test_awkward_documents(spark, rows):
    short = [r for r in rows if len(r[1] or "") < 4000]
    assert run(spark, short) == brute(spark, short)


def test_edits_everywhere(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abé日😀 ") for _ in range(n)) for n in (1, 2, 3, 5, 9, 17, 40)]
    texts = []
    for _ in range(70):
        s = list(r.choice(base))
        for _ in range(r.choice([0, 1, 1, 2])):
            k = r.randrange(len(s) + 1)
            kind = r.choice("idr")
            if kind == "i":
                s.insert(k, r.choice("abX"))
            elif k < len(s):
                s[k : k + 1] = [] if kind == "d" else [r.choice("abX")]
        texts.append("".join(s))
    rows = [(i, "\n".join(texts[i * 3 : i * 3 + 3]), "en", None, 1, 1, 1, None) for i in range(23)]
    assert run(spark, rows) == brute(spark, rows)


def test_long_line(spark):
    long = "".join(random.Random(2).choice("abcdefgh ") for _ in range(9000))
    rows = [(1, long, "", "", 0, 0, 0, None), (2, long[:5000] + "Z" + long[5000:], "", "", 0, 0, 0, None), (3, long[:7000] + "YY" + long[7000:], "", "", 0, 0, 0, None)]
    assert [x[2] for x in run(spark, rows)] == [0, 1, 0]


def test_empty_table(no_docs):
    assert op.deduplicated(no_docs).count() == 0


def test_native_plan(spark, sf):
    plan = op.op3_line_deletions(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_repeated_rows_count_a_near_line_once(spark):
    rows = [(i, t, "en", "s", 1, 1, 1, None) for i, t in [(1, "a line of words"), (2, "a line of word\nother"), (2, "a line of word\nother")]]
    got = run(spark, rows)
    assert got == brute(spark, rows) and [r[2:4] for r in got] == [(0, 0), (1, 1), (1, 1)]
