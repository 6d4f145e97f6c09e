import hashlib
import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrabin.llm import op12_randomness_secrets as op

PATTERNS = {"assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6), "access": (r"AKIA[A-Z0-9]+", 0, 0, 20), "hex": (r"[0-9a-f]+", 0, 0, 24)}


def brute(text):
    out = []
    for k, (p, flags, group, least) in enumerate(PATTERNS.values()):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text, flags) if len(m[group]) >= least]
    return sorted(out)


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(["password", "token", "Api_Key", "apikey", "SECRET", "=", ":", " ", '"', "'", "AKIA", "AKI", "ABCDEF0123", "0123456789abcdef", "a", "f0", "é", "ſecret", "toKen", "x.y", "zz", "-"]), max_size=14).map("".join))
def test_base_kinds_equal_the_patterns(text):
    assert op.base_spans(text) == brute(text)


def test_documents(docs, rows):
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in op.secrets(docs).collect())
    want = Counter()
    for i, t, *_ in rows:
        b = brute(t or "")
        want[(i, *(sum(k == n for _, k, _ in b) for n in range(3)), hashlib.sha256(op.join(b).encode()).hexdigest())] += 1
    assert got == want


def drawn(r, encoding, n):
    while True:
        t = "".join(r.choice(op.ENCODINGS[encoding]) for _ in range(n))
        if op.encoding_of(t) == encoding:
            return t


@pytest.mark.parametrize("encoding", list(op.ENCODINGS))
@pytest.mark.parametrize("n", [20, 40, 200])
def test_uniform_runs_pass_the_battery(encoding, n):
    r = random.Random(f"{encoding}{n}")
    p = [op.battery(drawn(r, encoding, n), encoding)[0] for _ in range(300)]
    assert sum(v < op.ALPHA for v in p) <= 12  # ALPHA, and what inferring the encoding by its rarest characters adds
    assert 0.25 < sum(v < 0.5 for v in p) / 300 < 0.7


@pytest.mark.parametrize("text", ["getUserNameFromTheDatabase", "InternationalizationHelper2", "aaaaaaaaaaaaaaaaaaaaaaa1", "docs/reference/index-of-names1", "abcdefghijklmnopqrstuvwxyz0123456789", "0101010101010101010a", "Donaudampfschifffahrtsgesellschaft", "deadbeefdeadbeefdeadbeefdeadbeef0", "2024-01-31-report-of-the-month"])
def test_ordinary_runs_fail_it(text):
    e = op.encoding_of(text)
    assert e is None or op.battery(text, e)[0] < op.ALPHA


def corpus(spark, keys, seed=1, n=400):
    """Prose with names and paths, and keys planted in some documents: (docs, {doc_id: key})."""
    r = random.Random(seed)
    syllables = ["an", "ber", "con", "de", "er", "fla", "ge", "hal", "in", "ka", "lo", "mer", "nis", "or", "pre", "qui", "re", "sta", "ti", "ung", "ver"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 6)))
    name = lambda: "".join(word().capitalize() for _ in range(3)) + r.choice(["", "2", "10"])
    path = lambda: "/".join(word() for _ in range(5)) + r.choice(["1", "-v2", "_new", "X"])
    rows, planted = [], {}
    for i in range(n):
        words = [word() for _ in range(r.randint(20, 200))] + [name(), path()]
        if i % 4 == 0 and keys:
            planted[i] = keys[i // 4 % len(keys)]
            words.insert(r.randrange(len(words)), planted[i])
        else:
            r.shuffle(words)
        rows.append((i, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), planted, dict(rows)


def test_keys_are_found_and_ordinary_strings_left(spark):
    r = random.Random(9)
    keys = [drawn(r, e, n) for e in ("hex", "base32", "base36", "base62", "base64", "base64url") for n in (24, 32, 43, 64, 88)]
    docs, planted, texts = corpus(spark, keys)
    found = hits = clean = 0
    for row in op.secrets(docs).collect():
        spans = [texts[row.doc_id][int(s) : int(e)] for k, s, e in (x.split(":") for x in row.spans.split(",") if x) if k == "random"]
        assert len(spans) == row.n_random
        if row.doc_id in planted:
            hits += planted[row.doc_id] in spans
            found += len(spans) - (planted[row.doc_id] in spans)
        else:
            clean += len(spans)
    assert hits >= 0.9 * len(planted)
    assert clean + found <= 0.05 * hits


def test_no_key_is_found_in_prose(spark):
    docs, _, _ = corpus(spark, [])
    assert sum(r.n_random for r in op.secrets(docs).collect()) <= 1


def test_pieces_beside_signs_are_found_once(spark):
    r = random.Random(4)
    key = drawn(r, "base62", 40)
    docs, _, _ = corpus(spark, [f"see/the/page/of/{key}/and/all/the/rest/of/it", drawn(r, "base64url", 64), drawn(r, "base64", 43) + "="])
    for row in op.secrets(docs).collect():
        spans = [tuple(map(int, x.split(":")[1:])) for x in row.spans.split(",") if x.startswith("random")]
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_rates_and_thresholds(spark):
    docs, _, texts = corpus(spark, [])
    models = op.Ordinary.of(op.scanned(docs))
    kind = lambda c: c.isdigit() + 2 * c.isupper()
    strings = [s for t in texts.values() for s in re.findall("[A-Za-z0-9]+", t) if 8 <= len(s) <= 15 and len(set(map(kind, s))) > 1]
    for k, m in enumerate(models):
        mine = [s for s in strings if op.family_of(s) == k]
        equal = sum(sum(a == b for i, a in enumerate(s) for b in s[i + 1 :]) for s in mine)
        changes = sum(kind(a) != kind(b) for s in mine for a, b in zip(s, s[1:]))
        assert m.equal == pytest.approx((equal + 0.065 * 4500) / (sum(len(s) * (len(s) - 1) / 2 for s in mine) + 4500))
        assert m.changes == pytest.approx((changes + 0.15 * 900) / (sum(len(s) - 1 for s in mine) + 900))
        assert m.equal_spread >= 1 and m.changes_spread >= 1
    assert all(z > 2 for z in op.thresholds(op.scanned(docs), models))


def test_empty_and_long(spark, no_docs):
    assert op.secrets(no_docs).collect() == []
    assert op.Ordinary.of(op.scanned(no_docs)) == [op.Ordinary(pytest.approx(op.COLLISIONS), 1.0, pytest.approx(op.CHANGES), 1.0)] * 3
    r = random.Random(2)
    key = drawn(r, "base62", 48)
    text = "word and more " * 600_000 + " " + key + " " + "x1" * 500_000
    docs = spark.createDataFrame([(1, text, "clash"), (2, None, "clash"), (None, "", "clash")], "doc_id long, text string, spans string")
    got = {r.doc_id: r.spans for r in op.secrets(docs).collect()}
    at = text.index(key)
    assert got == {1: f"random:{at}:{at + 48}", 2: "", None: ""}


def test_fisher_and_normal_tails():
    assert op.above(1.959963985) == pytest.approx(0.025)
    assert op.fisher([0.3]) == pytest.approx(0.3)
    x = 0.01 * 0.2
    assert op.fisher([0.01, 0.2]) == pytest.approx(x * (1 - math.log(x)))
