"""Vectorised text kernels shared by the corpus operators.

Everything works on UTF-8 bytes in numpy, a few MB at a time, so memory is bounded by the largest single
document.  A missing text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 19
NULL_ID = np.int64(2**63 - 1)  # a missing doc_id sorts after all others

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BYTE2 = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_P = U64(0x9E3779B97F4A7C15)
_P_INV = U64(pow(int(_P), -1, 2**64))
_P2 = U64(0xD1342543DE82EF95)
_P2_INV = U64(pow(int(_P2), -1, 2**64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class _Powers:
    """Powers of P and of its inverse mod 2**64, kept up to the largest length asked for (at most one slice)."""

    base, inverse = _P, _P_INV
    p = np.ones(1, U64)
    q = np.ones(1, U64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.p) < n:
            size = max(n, SLICE_BYTES + 1024)
            with np.errstate(over="ignore"):
                p, q = np.full(size, cls.base, U64), np.full(size, cls.inverse, U64)
                p[0] = q[0] = U64(1)
                cls.p, cls.q = np.multiply.accumulate(p), np.multiply.accumulate(q)
        return cls.p[:n], cls.q[:n]


class _Powers2(_Powers):
    base, inverse = _P2, _P2_INV


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Poly:
    """Prefix sums of v[i] * P**i: the hash of any [start, end) in constant time."""

    powers = _Powers

    def __init__(self, values: np.ndarray):
        n = len(values)
        p, self.inverse = self.powers.to(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * p[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U64))

    def grams(self, size: int) -> np.ndarray:
        """of() for every run of size values."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.inverse[:n] + U64(size))


class Poly2(Poly):
    """The same with another base: over second_values(), a hash that does not depend on Poly's."""

    powers = _Powers2


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _BYTE[buf]


def second_values(buf: np.ndarray) -> np.ndarray:
    return _BYTE2[buf]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about limit bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    n = len(column)
    if not n:
        return
    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data if data is not None else b"", np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes within each document, and the runs before each document."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def windows(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For documents of so many units: the first unit of every window of size units, and its document."""
    per = np.maximum(counts - size + 1, 0)
    total = int(per.sum())
    doc = np.repeat(np.arange(len(counts)), per)
    before = np.cumsum(counts) - counts
    at = np.arange(total) - np.repeat(np.cumsum(per) - per, per) + np.repeat(before, per)
    return at, doc


def order(keys: np.ndarray) -> np.ndarray:
    """An order that brings equal keys together (not by value): sorts the high bits with the index in the low ones."""
    n = len(keys)
    bits = max(1, int(n).bit_length())
    packed = np.sort((mix(keys) & ~U64((1 << bits) - 1)) | np.arange(n, dtype=U64))
    at = (packed & U64((1 << bits) - 1)).astype(np.int64)
    k = keys[at]
    high = packed >> U64(bits)
    same_high = high[1:] == high[:-1]
    if np.any(same_high & (k[1:] != k[:-1])):  # different keys share their high bits
        return np.argsort(keys, kind="stable")
    return at


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """order(keys), and where each group of equal keys starts in it."""
    at = order(keys)
    k = keys[at]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    return at, np.flatnonzero(new)


def pair_groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """groups() of equal pairs (a, b)."""
    at, first = groups(a)
    same = np.ones(len(at), bool)
    same[first] = False
    if np.any(b[at][1:][same[1:]] != b[at][:-1][same[1:]]):  # a alone does not tell them apart
        at = np.lexsort((b, a))
        new = np.ones(len(at), bool)
        new[1:] = (a[at][1:] != a[at][:-1]) | (b[at][1:] != b[at][:-1])
        first = np.flatnonzero(new)
    return at, first


def group_of(starts: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))


def covered(n: int, start: np.ndarray, length) -> np.ndarray:
    """Which of n units lie in any [start, start+length)."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, start, 1)
    np.subtract.at(change, start + length, 1)
    return np.cumsum(change[:n], dtype=np.int32) > 0


def per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values in each [offsets[i], offsets[i+1])."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of width values: where its leftmost minimum is, by as many high bits as their places leave.
    Doubles the width of minima of values with their places in the low bits."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = U64((1 << len(values).bit_length()) - 1)
    best, span = (values & ~low) | np.arange(len(values), dtype=U64), 1
    while span < width:
        step = min(span, width - span)
        best = np.minimum(best[: len(best) - step], best[step:])
        span += step
    return (best[:n] & low).astype(np.int64)
