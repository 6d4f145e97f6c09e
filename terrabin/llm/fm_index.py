"""An FM-index over integer sequences: a wavelet matrix of packed bits over the Burrows-Wheeler transform, in numpy."""

from __future__ import annotations

import numpy as np

from . import kernels as K
from . import suffix


_BELOW = (K.U64(1) << np.arange(64, dtype=K.U64)) - K.U64(1)
_FLIP = np.array([~K.U64(0), K.U64(0)])


class WaveletMatrix:
    """Ranks over a sequence of integers below 2**width, two bits a level: a level keeps both bits packed, and for each 64
    places where each of the four digits goes next, some 4 bits a place and level in all."""

    def __init__(self, values: np.ndarray, width: int):
        self.levels, n = [], len(values)
        for shift in reversed(range(0, width, 2)):
            digit = (values >> shift) & 3
            planes = []
            for bit in (digit >> 1, digit & 1):
                padded = np.zeros((n // 64 + 1) * 64, np.uint8)
                padded[:n] = bit
                planes.append(np.packbits(padded, bitorder="little").view(K.U64))
            zone = np.concatenate([[0], np.cumsum(np.bincount(digit, minlength=4))[:3]])
            ends = np.arange(0, n + 1, 64)
            before = np.stack([zone[d] + np.concatenate([[0], np.cumsum(digit == d)])[ends] for d in range(4)]).astype(np.uint32)
            self.levels.append((shift, *planes, before.reshape(-1), before.shape[1]))
            values = values[np.argsort(digit, kind="stable")]

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where each place, as a bound, comes to lie among the places of its symbol."""
        for shift, high, low, before, blocks in self.levels:
            digit = (symbol >> shift) & 3
            block = at >> 6
            match = (high[block] ^ _FLIP[digit >> 1]) & (low[block] ^ _FLIP[digit & 1]) & _BELOW[at & 63]
            at = before[digit * blocks + block] + np.bitwise_count(match).astype(np.int64)
        return at


class FMIndex:
    """Counts patterns of up to depth symbols in pieces of integers; no match crosses a piece's end."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray, depth: int):
        """symbols: any integers; ends: where each piece ends.  A stop (symbol 0) is kept after each piece."""
        self.alphabet, coded = np.unique(symbols, return_inverse=True)
        n = len(symbols) + len(ends)
        stop = ends + np.arange(len(ends))
        inside = np.ones(n, bool)
        inside[stop] = False
        text = np.zeros(n, np.int64)
        text[inside] = coded + 1
        size = np.diff(np.r_[-1, stop])
        levels = suffix.ranks(text, np.repeat(stop + 1, size), depth + 1)
        order = np.argsort(levels[-1][1], kind="stable")
        bwt = text[order - 1]  # before a piece's first symbol stands the stop of the piece before (of the last, for the first)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1))])
        self.matrix = WaveletMatrix(bwt, max(1, int(len(self.alphabet)).bit_length()))
        symbols_ = np.arange(len(self.alphabet) + 1)
        self.shift = self.before[symbols_] - self.matrix.descend(symbols_, np.zeros(len(symbols_), np.int64))
        self.n, self.coded = n, coded + 1
        self.piece = np.repeat(np.arange(len(ends)), size)[order]  # of each suffix
        self.weights = np.arange(n + 1)
        common = np.minimum(suffix.common_prefixes(levels, np.repeat(stop + 1, size), order), 255).astype(np.uint8)
        self.common = [np.append(common, np.uint8(0))]  # with the suffix before; minima of 1, 2, 4... from each place on
        while len(self.common[-1]) > 1 << (len(self.common) - 1):
            step, last = 1 << (len(self.common) - 1), self.common[-1]
            self.common.append(np.minimum(last[:-step], last[step:]))

    def weigh(self, copies: np.ndarray) -> None:
        """From now on each piece counts so often."""
        self.weights = np.concatenate([[0], np.cumsum(copies[self.piece])])

    def depth(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The length of the parent of an interval in the common-prefix interval tree."""
        return np.maximum(self.common[0][lo], self.common[0][hi]).astype(np.int64)

    def widen(self, lo: np.ndarray, hi: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the first length (1 or more) symbols that all suffixes in [lo, hi) share."""
        return lo - self._reach(lo, length, -1), hi + self._reach(hi, length, 1)

    def _reach(self, at: np.ndarray, length: np.ndarray, way: int) -> np.ndarray:
        """How many places from at on, backwards or forwards, have common prefixes of length or more: in steps that double
        while they succeed, as most reaches are short, and then halve."""
        moved, tops = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)

        def further(k: int, some: np.ndarray) -> np.ndarray:
            least, step = self.common[k], 1 << k
            first = at[some] - moved[some] - step + 1 if way < 0 else at[some] + moved[some]
            inside = (first >= 0) & (first < len(least))
            some = some[inside & (least[np.where(inside, first, 0)] >= length[some])]
            moved[some] += step
            return some

        some, k = np.arange(len(at)), 0
        while len(some) and k < len(self.common):
            some = further(k, some)
            k += 1
            tops[some] = k
        for j in reversed(range(k)):
            further(j, np.flatnonzero(tops > j))
        return moved

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the interval of symbol + pattern from that of pattern."""
        both = self.matrix.descend(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        shift = self.shift[symbol]
        return shift + both[: len(lo)], shift + both[len(lo) :]


def matching_statistics(index: FMIndex, sequence: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int, least: int = 2) -> np.ndarray:
    """For each place of each piece sequence[starts:ends]: how many symbols from there on, depth at most and within the
    piece, occur at least `least` times in the index.  All pieces are read backwards in one batch."""
    out = np.zeros(len(sequence), np.int64)
    by = np.argsort(starts - ends, kind="stable")  # the longest first: those that still have symbols are a prefix
    length = (ends - starts)[by]
    lo, hi, q = np.zeros(len(by), np.int64), np.full(len(by), index.n, np.int64), np.zeros(len(by), np.int64)
    for k in range(1, int(length[0]) + 1 if len(length) else 1):
        live = int(np.searchsorted(-length, -k, "right"))
        place = ends[by[:live]] - k
        symbol = sequence[place]
        cut = np.flatnonzero(q[:live] == depth)  # a match of full depth loses its last symbol first
        q[cut] = depth - 1
        cut = cut[index.depth(lo[cut], hi[cut]) >= depth - 1]
        if depth > 1:
            lo[cut], hi[cut] = index.widen(lo[cut], hi[cut], q[cut])
        else:
            lo[cut], hi[cut] = 0, index.n
        open_ = np.arange(live)
        while len(open_):
            a, b = index.step(symbol[open_], lo[open_], hi[open_])
            ok = (b > a) & (index.weights[b] - index.weights[np.minimum(a, b)] >= least)
            on = open_[ok]
            lo[on], hi[on] = a[ok], b[ok]
            q[on] += 1
            open_ = open_[~ok]
            open_ = open_[q[open_] > 0]
            shorter = index.depth(lo[open_], hi[open_])
            q[open_] = shorter
            none = shorter == 0
            lo[open_[none]], hi[open_[none]] = 0, index.n
            some = open_[~none]
            lo[some], hi[some] = index.widen(lo[some], hi[some], shorter[~none])
        out[place] = q[:live]
    return out
