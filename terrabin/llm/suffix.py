"""Enhanced suffix arrays of many short pieces, in numpy: prefix doubling, longest common prefixes, interval tree."""

from __future__ import annotations

import numpy as np


def ranks(symbols: np.ndarray, end: np.ndarray, upto: int) -> list[tuple[int, np.ndarray]]:
    """(span, rank of each suffix by its first span symbols) for doubling spans.

    symbols: integers of the pieces, one after another; end: the end of each position's own piece, at which a
    suffix stops.  Equal ranks mean equal prefixes, stops included.
    """
    n = len(symbols)
    at = np.arange(n)
    rank, span = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1, 1
    out = [(span, rank)]
    while span < upto:
        later = np.minimum(at + span, n - 1)
        second = np.where(at + span < end, rank[later], 0)
        rank = np.unique(rank * (n + 1) + second, return_inverse=True)[1].astype(np.int64) + 1
        span *= 2
        out.append((span, rank))
    return out


def common_prefixes(levels: list[tuple[int, np.ndarray]], end: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix in order with the one before it (0 for the first), by descending spans."""
    n = len(end)
    lcp = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return lcp
    a, b = order[:-1], order[1:]
    got = np.zeros(len(a), np.int64)
    for span, rank in reversed(levels):
        ia, ib = a + got, b + got
        inside = (ia < end[a]) & (ib < end[b])
        same = inside & (rank[np.minimum(ia, n - 1)] == rank[np.minimum(ib, n - 1)])
        got = np.where(same, np.minimum(got + span, end[a] - a), got)
    lcp[1:] = got
    return lcp


def maximal_repeats(lcp: list[int], left: list[int], least: list[int]) -> list[tuple[int, int, int, int]]:
    """(first, last, length, least) of the left-diverse intervals of a run of the suffix array.

    One stack scan over lcp (lcp[i] stands between suffix i - 1 and i; the first is ignored) visits the common-prefix
    interval tree bottom-up.  left: the symbol before each suffix, negative where there is none to compare; an
    interval is left-diverse if two of its suffixes differ there, so that it cannot be extended to the left.
    least: a value of each suffix, of which an interval gets the minimum.
    """
    out, stack = [], []  # stack: [lcp, first, left symbol or -1 if diverse, least]
    n = len(lcp)
    for i in range(1, n + 1):
        height = lcp[i] if i < n else 0
        first, symbol, low = i - 1, left[i - 1], least[i - 1]
        while stack and stack[-1][0] > height:
            top = stack.pop()
            if top[2] != symbol:
                symbol = -1
            low = top[3] if top[3] < low else low
            first = top[1]
            if symbol < 0:
                out.append((first, i - 1, top[0], low))
        if height > 0:
            if stack and stack[-1][0] == height:
                top = stack[-1]
                if top[2] != symbol:
                    top[2] = -1
                if low < top[3]:
                    top[3] = low
            else:
                stack.append([height, first, symbol, low])
    return out
