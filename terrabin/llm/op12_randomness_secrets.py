"""Secrets by patterns and by a battery of randomness tests with control of false discoveries.

The base kinds are fixed patterns, leftmost and non-overlapping per kind.  The method adds spans of kind random: runs of
16 or more characters of an encoding (base64's with its padding, whole and cut at its signs) that look like keys.

A run's encoding is inferred as the smallest alphabet that holds it; runs of one class of characters (words, numbers) have
none.  Three tests hold the run against uniform characters of that alphabet: Pearson's chi-squared, two-sided; the number
of changes between lower case, upper case and digits; and the serial correlation of neighbouring values.  Fisher's method
joins their p-values, and a run that uniform characters give less than once in 1 / ALPHA is not a key.

Short runs pass those tests by lack of power, so a run must also differ from ordinary strings of its length.  What is
ordinary (how often two characters of a string are equal, how often neighbours differ in class, how both vary) is measured
over all strings of 8 to 15 letters and digits of two classes in the corpus (names, mostly, and too short to be runs), apart
for hexadecimal ones, those of one case, and those of both.  Both, weighed by what a
key of the run's encoding and length would show, make a z value, and the Benjamini-Hochberg step at rate FDR, within each
class of lengths and over all runs of the corpus, decides which are discoveries.

Texts are read once: a document's spans, runs and sums of ordinary strings are stored (bounded by its text); one
aggregate of fixed size (length classes by bins of z) gives the thresholds; the rest is SQL.

Edge cases: null and empty texts have no spans; offsets are code points; repeated rows, null ids and equal texts are kept
and judged alike; fixed rates count as a hundred ordinary strings, so that a corpus without any has thresholds too; other columns are ignored; each text is
read whole, in time linear in its length.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import prepare, stored, table

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
RANDOM = KINDS.index("random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the whole run, as it is greedy and starts at the run's first AKIA
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_PIECE = re.compile(r"[A-Za-z0-9]{16,}")
_ORDINARY = re.compile(r"(?<![A-Za-z0-9])(?!(?:[a-z]+|[A-Z]+|[0-9]+)(?![A-Za-z0-9]))[A-Za-z0-9]{8,15}(?![A-Za-z0-9])")

_LOW, _UP, _DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
#: Encodings by size, each in the order of its values.
ENCODINGS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UP + "234567",
    "base36": _DIGITS + _LOW,
    "BASE36": _DIGITS + _UP,
    "base62": _UP + _LOW + _DIGITS,
    "base64": _UP + _LOW + _DIGITS + "+/",
    "base64url": _UP + _LOW + _DIGITS + "-_",
}
_CLASS = np.full(128, 3, np.uint8)
for _k, _members in enumerate((_LOW, _UP, _DIGITS)):
    _CLASS[[ord(c) for c in _members]] = _k

ALPHA, FDR = 0.01, 0.05
#: Where the classes of lengths begin.
LENGTHS = (16, 24, 32, 48, 96)
BIN, BINS = 0.1, 400
#: Rates of ordinary strings before the corpus is seen (English text's collisions, a change in seven neighbours), and the
#: strings of ten characters that they weigh as much as.
COLLISIONS, CHANGES, PRIOR = 0.065, 0.15, 100
FAMILIES = 3
_SUMS = ("strings", "equal", "pairs", "equal2", "changes", "near", "changes2")


# ---- tests ---------------------------------------------------------------------------------------------------


def above(z: float) -> float:
    """The upper tail of the standard normal distribution."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def two_sided(z: float) -> float:
    return min(1.0, 2 * above(abs(z)))


def fisher(p: list[float]) -> float:
    """The joint p-value of independent ones: the tail of chi-squared with 2 len(p) degrees, which has a closed form."""
    x = -sum(math.log(max(v, 1e-300)) for v in p)
    return math.exp(-x) * sum(x**k / math.factorial(k) for k in range(len(p)))


def chi_squared(counts: np.ndarray, size: int, n: int) -> float:
    """Pearson's statistic as a normal deviate by Wilson and Hilferty, with the exact mean and variance at n characters."""
    x = size / n * float((counts.astype(float) ** 2).sum()) - n
    mean, variance = size - 1, 2 * (size - 1) * (n - 1) / n
    spread = variance / (9 * mean**2)
    return ((x / mean) ** (1 / 3) - (1 - spread)) / math.sqrt(spread)


@cache
def _class_shares(encoding: str) -> tuple[float, ...]:
    kinds = _CLASS[[ord(c) for c in ENCODINGS[encoding]]]
    return tuple(float(v) for v in np.bincount(kinds) / len(kinds))


def class_runs(changes: int, encoding: str, n: int) -> float:
    """Changes of class among n independent characters, as a normal deviate."""
    q = _class_shares(encoding)
    p = 1 - sum(v * v for v in q)
    twice = sum(v * (1 - v) ** 2 for v in q)
    return (changes - (n - 1) * p) / math.sqrt((n - 1) * p * (1 - p) + 2 * (n - 2) * (twice - p * p))


def serial_correlation(values: np.ndarray) -> float:
    n, d = len(values), values - values.mean()
    total = float((d * d).sum())
    return (float((d[1:] * d[:-1]).sum()) / total + 1 / n) * math.sqrt(n) if total else math.inf


def encoding_of(text: str) -> str | None:
    """The smallest encoding that holds a run; None for one class of characters, or signs of two encodings."""
    members = set(text)
    if len(set(_CLASS[[ord(c) for c in members]].tolist())) < 2:
        return None
    return next((name for name, alphabet in ENCODINGS.items() if members <= set(alphabet)), None)


@cache
def _values(encoding: str) -> np.ndarray:
    out = np.zeros(128, np.uint8)
    out[[ord(c) for c in ENCODINGS[encoding]]] = np.arange(len(ENCODINGS[encoding]))
    return out


def battery(text: str, encoding: str) -> tuple[float, int, int, float, float]:
    """Fisher's p-value that the run is uniform in its encoding, equal pairs of characters, changes of class, and the
    shares of both that uniform characters have."""
    raw, size, n = np.frombuffer(text.encode(), np.uint8), len(ENCODINGS[encoding]), len(text)
    values = _values(encoding)[raw]
    counts = np.bincount(values, minlength=size)
    changes = int((np.diff(_CLASS[raw].astype(np.int8)) != 0).sum())
    z = (chi_squared(counts, size, n), class_runs(changes, encoding, n), serial_correlation(values.astype(float)))
    return fisher([two_sided(v) for v in z]), int((counts * (counts - 1) // 2).sum()), changes, 1 / size, 1 - sum(v * v for v in _class_shares(encoding))


def candidates(text: str) -> list[tuple]:
    """(start, end, length, *battery) of runs, whole, then cut at signs; a piece names its run by position."""
    out = []
    for m in _RUN.finditer(text):
        body = m[0].rstrip("=")
        whole = -1
        if encoding := encoding_of(body):
            whole = len(out)
            out.append((m.start(), m.end(), len(body), *battery(body, encoding), -1))
        if not body.isalnum():
            for p in _PIECE.finditer(body):
                if encoding := encoding_of(p[0]):
                    out.append((m.start() + p.start(), m.start() + p.end(), len(p[0]), *battery(p[0], encoding), whole))
    return out


def family_of(text: str) -> int:
    """Hexadecimal, one case, both cases."""
    return 0 if encoding_of(text) in ("hex", "HEX") else 1 if text.upper() == text or text.lower() == text else 2


def ordinary(text: str) -> np.ndarray:
    """Sums over ordinary strings by family: strings, equal pairs c, pairs P, c c / P, changes s, neighbours N, s s / N."""
    total = np.zeros((FAMILIES, len(_SUMS)))
    for t in _ORDINARY.findall(text):
        n = len(t)
        pairs, near = n * (n - 1) / 2, n - 1
        equal = sum(k * (k - 1) for k in Counter(t).values()) / 2
        kinds = _CLASS[np.frombuffer(t.encode(), np.uint8)]
        changes = int((kinds[1:] != kinds[:-1]).sum())
        total[family_of(t)] += (1, equal, pairs, equal * equal / pairs, changes, near, changes * changes / near)
    return total.reshape(-1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# ---- the corpus ----------------------------------------------------------------------------------------------

_COLUMNS = [f"{s}_{k}" for k in range(FAMILIES) for s in _SUMS]
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_FIELDS = {"start": "long", "end": "long", "length": "long", "p": "double", "equal": "long", "changes": "long", "key_equal": "double", "key_changes": "double", "whole": "long"}
_CANDIDATE = pa.list_(pa.struct([(f, pa.float64() if kind == "double" else pa.int64()) for f, kind in _FIELDS.items()]))
_SCAN = (
    "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, base array<struct<start:long,kind:int,end:long>>, "
    f"found array<struct<{','.join(f'{f}:{kind}' for f, kind in _FIELDS.items())}>>, " + ", ".join(f"{s} double" for s in _COLUMNS)
)


def scanned(docs: DataFrame) -> DataFrame:
    """The one pass over texts; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            base = [base_spans(t) for t in texts]
            counts = [pa.array([sum(k == kind for _, k, _ in s) for s in base], pa.int64()) for kind in range(len(BASE))]
            digest = pa.array([hashlib.sha256(join(s).encode()).hexdigest() for s in base], pa.string())
            spans = pa.array([[dict(zip(("start", "kind", "end"), s)) for s in row] for row in base], _SPAN)
            found = pa.array([[dict(zip(_FIELDS, c)) for c in candidates(t)] for t in texts], _CANDIDATE)
            sums = np.array([ordinary(t) for t in texts]).reshape(len(texts), len(_COLUMNS))
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, spans, found, *(pa.array(c) for c in sums.T)], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "base", "found", *_COLUMNS])

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SCAN)


@dataclass
class Ordinary:
    """Rates of equal pairs and of changes of class in ordinary strings, and how much more they vary than by chance."""

    equal: float = COLLISIONS
    equal_spread: float = 1.0
    changes: float = CHANGES
    changes_spread: float = 1.0

    @staticmethod
    def of(scan: DataFrame) -> list[Ordinary]:
        """Of each family."""
        total = np.array(scan.agg(*(F.coalesce(F.sum(c), F.lit(0.0)) for c in _COLUMNS)).first(), float).reshape(FAMILIES, len(_SUMS))
        return [Ordinary._of(*row) for row in total]

    @staticmethod
    def _of(strings, equal, pairs, equal2, changes, near, changes2) -> Ordinary:
        a = (equal + COLLISIONS * 45 * PRIOR) / (pairs + 45 * PRIOR)
        b = (changes + CHANGES * 9 * PRIOR) / (near + 9 * PRIOR)
        spread = lambda square, total, n, rate: max((square - 2 * rate * total + rate * rate * n) / (rate * strings), 1.0) if strings else 1.0
        return Ordinary(float(a), float(spread(equal2, equal, pairs, a)), float(b), float(spread(changes2, changes, near, b)))

    def z(self, c: Column) -> Column:
        """How far a run is from ordinary strings of its length, towards a key: by equal pairs and by changes of class, each
        weighed by how far a key would be."""
        n = c["length"].cast("double")
        pairs, near = n * (n - 1) / 2, n - 1
        fewer = lambda share: (self.equal * pairs - share) / F.sqrt(self.equal_spread * self.equal * pairs)
        more = lambda share: (share - self.changes * near) / F.sqrt(self.changes_spread * self.changes * near)
        by_pairs, by_changes = (F.greatest(v, F.lit(1e-9)) for v in (fewer(c["key_equal"] * pairs), more(c["key_changes"] * near)))
        return (by_pairs * fewer(c["equal"]) + by_changes * more(c["changes"])) / F.sqrt(by_pairs * by_pairs + by_changes * by_changes)


def _z(models: list[Ordinary], c: Column) -> Column:
    """By the family of a run's encoding, told by its size."""
    return F.when(c["key_equal"] > 1 / 20, models[0].z(c)).when(c["key_equal"] > 1 / 50, models[1].z(c)).otherwise(models[2].z(c))


def _length_class(length: Column) -> Column:
    return sum(((length >= at).cast("int") for at in LENGTHS[1:]), F.lit(0))


def thresholds(scan: DataFrame, models: list[Ordinary]) -> list[float]:
    """The least z of a discovery in each class of lengths: Benjamini and Hochberg's step over bins of z, a bin's runs
    taken at its lower end."""
    c = F.col("c")
    z_bin = F.floor(F.least(F.greatest(_z(models, c), F.lit(0.0)) / BIN, F.lit(float(BINS)))).cast("int")
    rows = scan.select(F.explode("found").alias("c")).groupBy(_length_class(c["length"]).alias("k"), z_bin.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    out = []
    for k in range(len(LENGTHS)):
        bins = sorted(((r.b, r.n) for r in rows if r.k == k), reverse=True)
        total, seen, least = sum(n for _, n in bins), 0, math.inf
        for b, n in bins:
            seen += n
            if b and total * above(b * BIN) <= FDR * seen:
                least = b * BIN
        out.append(least)
    return out


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans, n_random."""
    scan = stored(scanned(docs), "runs")
    models = Ordinary.of(scan)
    least = thresholds(scan, models)

    def key(c: Column) -> Column:
        bound = F.lit(least[0])
        for at, z in zip(LENGTHS[1:], least[1:]):
            bound = F.when(c["length"] >= at, F.lit(z)).otherwise(bound)
        return (c["p"] >= ALPHA) & (_z(models, c) >= bound)

    inside = lambda c: (c["whole"] >= 0) & key(F.get(F.col("found"), c["whole"].cast("int")))
    keys = F.filter("found", lambda c: key(c) & ~inside(c))
    added = F.transform(keys, lambda c: F.struct(c["start"].alias("start"), F.lit(RANDOM).alias("kind"), c["end"].alias("end")))
    spans = F.array_sort(F.concat("base", added))
    names = F.array(*(F.lit(k) for k in KINDS))
    text = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return scan.select("doc_id", *(f"n_{k}" for k in BASE), "base_sha256", F.array_join(text, ",").alias("spans"), F.size(added).cast("long").alias("n_random"))


def op12_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
