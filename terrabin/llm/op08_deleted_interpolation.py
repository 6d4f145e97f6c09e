"""A bigram language model smoothed by deleted interpolation.

P(w|h) mixes the maximum-likelihood bigram, unigram and uniform estimates; the weights depend on the bucket (power of
two) of the context's count and are learned by expectation-maximisation on held-out counts: the training documents of one
fold (crc32 of the id mod 7 is DELETED) are scored with the counts of the other training folds, their own deleted.  What
is deleted depends on ids alone, never on how documents are dealt to blocks.

A block holds documents of one fold, so that the buckets that total its keys know its fold by its number.  Blocks send their distinct unigrams and bigrams with counts to buckets of keys and get the totals back (see
exchange.py); the whole corpus is counted, nothing is broadcast but the weights.  What EM needs of all tokens is a
histogram over (context bucket, bigram probability, unigram count) in quarter octaves, of bounded size.

Words go by 64-bit hashes, and pairs of words by 64-bit hashes of the two.

Edge cases: a null or empty text is the end token alone; null ids are in training as crc32 of them is null, in another fold by
their text; repeated
rows count as often as they come; with no training tokens only the uniform estimate scores; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from . import kernels as K
from .session import stored, table

FOLDS, HELD_OUT, DELETED, BUCKETS, STEP, ROUNDS = 7, 2, 0, 24, 4, 60
END, START = K.U64(0xA5A5_1234_5678_9ABD), K.U64(0x5A5A_8765_4321_FEDB)
KINDS = "kind int, payload binary"
#: Tokens whose counts one stored row holds, unless a document has more.
ROW_TOKENS = 1 << 17
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def folded(docs: DataFrame, size: int | None = None) -> tuple[DataFrame, int]:
    """(block, doc_id, text), as many blocks a fold, of which the block's number is the remainder; and the number of blocks."""
    blocked, n, _ = X.blocks(docs, size)
    training = [k for k in range(FOLDS) if k not in (HELD_OUT, DELETED)]
    by_text = F.get(F.array(*map(F.lit, training)), F.pmod(F.xxhash64("text"), F.lit(len(training))).cast("int"))
    fold = F.coalesce((F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS).cast("int"), by_text)
    each = -(-n // FOLDS)
    own = F.pmod(F.xxhash64("doc_id", "text"), F.lit(each)).cast("int")
    return blocked.select((own * FOLDS + fold).alias("block"), "doc_id", "text"), each * FOLDS


def tokens(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, their contexts, tokens of each text, held-out texts, training tokens."""
    words, counts = [], []
    for i, j, raw, offsets in K.text_slices(t["text"]):
        buf = LOWER[raw]
        starts, ends, at = K.runs(~K.SPACE[buf], offsets)
        w = K.Poly(K.byte_values(buf)).of(starts, ends)
        words.append(np.insert(w, at[1:], END))
        counts.append(np.diff(at) + 1)
    w = np.concatenate(words) if words else np.zeros(0, K.U64)
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    first = np.cumsum(n) - n
    h = np.empty_like(w)
    h[1:] = w[:-1]
    h[first] = START
    held = np.array([i is not None and zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in t["doc_id"].to_pylist()], bool)
    return w, h, n, held, ~np.repeat(held, n)


def keyed(w: np.ndarray, h: np.ndarray, train: np.ndarray):
    """Distinct unigram and bigram keys, the key of each token, and training counts of each key."""
    out = []
    with np.errstate(over="ignore"):
        pair = K.mix(h * K.U64(0x9E3779B97F4A7C15) + w)
    for keys in (w, pair):
        distinct, at = np.unique(keys, return_inverse=True)
        out.append((distinct, at, np.bincount(at[train], minlength=len(distinct))))
    return out


def send(n_buckets: int):
    def run(t: pa.Table) -> pa.Table:
        block = t["block"][0].as_py()
        w, h, _, held, train = tokens(X.ordered(t))
        (uni, _, uc), (bi, _, bc) = keyed(w, h, train)
        out = []
        for k, bounds in enumerate(zip(cuts(uni, n_buckets), cuts(bi, n_buckets), strict=True)):
            (a, b), (c, d) = bounds
            if a < b or c < d:
                out.append((k, block, X.pack(X.squeezed(uni[a:b]), X.narrow(uc[a:b]), X.squeezed(bi[c:d]), X.narrow(bc[c:d]))))
        return X.rows(X.MESSAGE, bucket=[x[0] for x in out], block=[x[1] for x in out], payload=[x[2] for x in out])

    return run


def cuts(keys: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Sorted keys are dealt to buckets by range of the whole hash."""
    edges = np.searchsorted(keys, np.array([(k << 64) // n for k in range(1, n)], K.U64))
    edges = [0, *edges.tolist(), len(keys)]
    return list(zip(edges, edges[1:], strict=False))


def total(t: pa.Table) -> pa.Table:
    """Totals of a bucket's keys, sent back in the order in which each block sent its keys; blocks of the deleted fold also
    get what is left without it."""
    bucket = t["bucket"][0].as_py()
    names = t["block"].to_pylist()
    parts = [X.unpack(p) for p in t["payload"].to_pylist()]
    deleted = [b % FOLDS == DELETED for b in names]
    answers = []
    for k in (0, 2):
        keys = [X.unsqueezed(p[k]) for p in parts]
        size = [len(x) for x in keys]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([p[k + 1] for p in parts])
        sums = np.bincount(at, counts, minlength=len(distinct)).astype(np.int64)
        own = np.repeat(deleted, size)
        left = sums - np.bincount(at[own], counts[own], minlength=len(distinct)).astype(np.int64)
        bounds = np.cumsum(size)[:-1]
        answers.append((np.split(sums[at], bounds), sums, [left[x] if d else None for x, d in zip(np.split(at, bounds), deleted, strict=True)], left))
    (uni, known, uni_left, known_left), (bi, _, bi_left, _) = answers
    none, vocabulary = np.zeros(3, np.int64), np.array([(known > 0).sum(), known.sum(), known_left.sum()], np.int64)  # told to one block
    more = [[X.planes(a), X.planes(b)] if d else [] for a, b, d in zip(uni_left, bi_left, deleted, strict=True)]
    out = [X.pack(X.planes(a), X.planes(b), none if k else vocabulary, *x) for k, (a, b, x) in enumerate(zip(uni, bi, more, strict=True))]
    return X.rows(X.ANSWER, block=names, bucket=[bucket] * len(names), payload=out)


def octave(p: np.ndarray) -> np.ndarray:
    """0 for 0, else 1 + quarter octaves below 1 (or above, for counts)."""
    return np.where(p > 0, 1 + np.round(STEP * np.abs(np.log2(np.where(p > 0, p, 1)))), 0).astype(np.int64)


def context_bucket(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.minimum(1 + np.floor(np.log2(np.maximum(c, 1))), BUCKETS - 1), 0).astype(np.int64)


def receive(left: pa.Table, right: pa.Table) -> pa.Table:
    """The counts of each token of a block's documents, and the histogram of its training tokens for EM."""
    t = X.ordered(left)
    w, h, n, held, train = tokens(t)
    (uni, u_at, _), (_, b_at, _) = keyed(w, h, train)
    answers = [X.unpack(p) for _, p in sorted(zip(right["bucket"].to_pylist(), right["payload"].to_pylist(), strict=True))]
    u_all, b_all = (np.concatenate([X.unplanes(a[k]) for a in answers]).astype(np.int64) for k in (0, 1))
    first = np.cumsum(n) - n
    cw, chw = u_all[u_at], b_all[b_at]
    cells = of = np.zeros(0, np.int64)
    if t["block"][0].as_py() % FOLDS == DELETED:  # held-out counts: those of the other folds
        u_left, b_left = (np.concatenate([X.unplanes(a[k]) for a in answers]).astype(np.int64) for k in (3, 4))
        dw, dhw = u_left[u_at], b_left[b_at]
        dh = np.empty_like(dw)
        dh[1:] = dw[:-1]
        dh[first] = u_left[np.searchsorted(uni, END)]  # as many starts as ends
        cells, of = np.unique(cell(dh, dhw, dw)[train], return_counts=True)
    none, ids, upto = np.array(t["doc_id"].is_null()), X.ids_of(t), np.cumsum(n)
    out, a = [], 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(upto, first[a] + ROW_TOKENS, "right")))
        s = slice(first[a], upto[b - 1])
        out.append(X.pack(ids[a:b], none[a:b], held[a:b], n[a:b], X.planes(cw[s]), X.planes(chw[s])))
        a = b
    return X.rows(KINDS, kind=[0] * len(out) + [1], payload=[*out, X.pack(cells, of, sum(a[2] for a in answers))])


def cell(h: np.ndarray, hw: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The histogram's cell of a token, by the counts of its context, of the pair and of the word."""
    p2, p1 = octave(hw / np.maximum(h, 1)), octave(w.astype(float))
    return (context_bucket(h) << 20) | (np.minimum(p2, 1023) << 10) | np.minimum(p1, 1023)


def learn(cells: np.ndarray, of: np.ndarray, left_tokens: int, vocabulary: int) -> np.ndarray:
    """EM over the histogram: weights of bigram, unigram and uniform by context bucket."""
    b, q2, q1 = cells >> 20, (cells >> 10) & 1023, cells & 1023
    p = np.stack([np.where(q2 > 0, 2.0 ** (-(q2 - 1) / STEP), 0), np.where(q1 > 0, 2.0 ** ((q1 - 1) / STEP), 0) / max(left_tokens, 1), np.full(len(cells), 1 / (vocabulary + 1))])
    weights = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(ROUNDS):
        share = weights[b].T * p
        share *= of / share.sum(0)
        sums = np.stack([np.bincount(b, s, BUCKETS) for s in share], 1) + [0.1, 0.5, 0.5]
        weights = sums / sums.sum(1, keepdims=True)
    weights[0] = [0, *(weights[0, 1:] / weights[0, 1:].sum())]  # an unseen context has no bigram estimate
    return weights


@dataclass(frozen=True)
class Model:
    """weights: of bigram, unigram and uniform by context bucket; tokens and different tokens in training."""

    weights: np.ndarray
    tokens: int
    vocabulary: int

    def log10(self, h: np.ndarray, hw: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Of each token's probability, from the counts of its context, of the pair and of the word."""
        k = self.weights[context_bucket(h)]
        return np.log10(k[:, 0] * hw / np.maximum(h, 1) + k[:, 1] * w / max(self.tokens, 1) + k[:, 2] / (self.vocabulary + 1))


def counted(docs: DataFrame, size: int | None = None) -> tuple[DataFrame, Model]:
    """The stored counts of all tokens, and the model learned from them; size: bytes a block holds."""
    blocked, n = folded(docs, size)
    sent = blocked.groupBy("block").applyInArrow(X.frugal(send(n)), X.MESSAGE)
    answers = sent.groupBy("bucket").applyInArrow(X.frugal(total), X.ANSWER)
    kept = stored(blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(X.frugal_pair(receive), KINDS), "counts")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vocabulary and histogram rows of a partition, added up."""
        sums, cells = np.zeros(3, np.int64), {}
        for b in batches:
            for data in b.column(0).to_pylist():
                cell_, of, stats = X.unpack(data)
                sums += stats
                for c, k in zip(cell_.tolist(), of.tolist(), strict=True):
                    cells[c] = cells.get(c, 0) + k
        yield pa.RecordBatch.from_pydict({"cell": pa.array([-1, -2, -3, *cells], pa.int64()), "n": pa.array([*sums.tolist(), *cells.values()], pa.int64())})

    got = kept.where("kind = 1").select("payload").mapInArrow(fold, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    got = {r["cell"]: r["n"] for r in got}
    vocabulary, total_tokens, left_tokens = got.pop(-1, 0), got.pop(-2, 0), got.pop(-3, 0)
    pairs = np.array(sorted(got.items()), np.int64).reshape(-1, 2)
    return kept.where("kind = 0").select("payload"), Model(learn(pairs[:, 0], pairs[:, 1], left_tokens, vocabulary), total_tokens, vocabulary)


def scored(docs: DataFrame) -> DataFrame:
    """The model is counted, learned and applied; one row a document."""
    kept, model = counted(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        base = np.log10(m.tokens + m.vocabulary + 1)
        for b in batches:
            for data in b.column(0).to_pylist():
                ids, none, held, n, *counts = X.unpack(data)
                cw, chw = (X.unplanes(x).astype(np.float64) for x in counts)
                first = np.cumsum(n) - n
                ch = np.empty_like(cw)
                ch[1:] = cw[:-1]
                ch[first] = cw[first + n - 1]  # as many starts as ends
                known, low, high = (np.add.reduceat(x, first) for x in ((cw > 0).astype(np.int64), np.log10(cw + 1) - base, m.log10(ch, chw, cw)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64(), mask=none), pa.array(held), pa.array(n), pa.array(known), pa.array(np.full(len(n), m.tokens)), pa.array(low), pa.array(high)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return kept.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
