"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into three blocks (21, 21 and 22 bits).  Two fingerprints within 4 bits differ in at
most one bit of some block.  The anchors of a block are the code words of a covering code: a perfect [15,11]
Hamming code (covering radius 1) on its first 15 bits, all words on the rest.  A fingerprint's home is the anchor
nearest to it; it is replicated to every anchor within covering radius plus threshold that can be the home of a
fingerprint one bit away, 7 or 14 anchors a block of 2**17 or 2**18.  So the homes of one fingerprint meet all
others within the threshold, and no pair is missed.

Per anchor, homes are compared with all members by XOR and bit counts, in numpy.  Only links that join two so far
unconnected fingerprints are emitted (a forest), so a group of g near copies gives g - 1 links, not g squared; equal
fingerprints are one before that.  Components follow by large-star and small-star steps over distinct fingerprints.

Edge cases: null and empty texts have fingerprint zero and link like any other; texts of fewer words than a shingle
are one shingle; null ids do not become a component's id unless it holds no other; repeated rows are kept; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .components import connected
from .session import prepare, stored, table

THRESHOLD, SHINGLE, SEED = 4, 4, 42
BLOCKS = ((0, 21), (21, 21), (42, 22))
LINK_ROWS = 500_000
#: Members of an anchor beyond which it is split.
HOT = 100_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, th (the text's hash), fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, _, raw, offsets in K.text_slices(b.column(1)):
                out.append(slice_fingerprints(LOWER[raw], offsets, shingle))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.concatenate(out) if out else np.zeros(0, K.U64)).view(pa.int64())], ["doc_id", "th", "fp"])

    prepare(docs.sparkSession)
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(text)).mapInArrow(run, "doc_id long, th long, fp long")


def slice_fingerprints(buf: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    starts, ends, at = K.runs(~K.SPACE[buf], offsets)
    counts = np.diff(at)
    size = ends - starts
    # words joined by one space
    place = np.cumsum(size + 1) - size - 1
    joined = np.full(int((size + 1).sum()), 32, np.uint8)
    inside = np.repeat(place - starts, size) + (src := np.flatnonzero(~K.SPACE[buf]))
    joined[inside] = buf[src]
    text, stop = joined.tobytes(), place + size
    n = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    first, doc = K.windows(np.where(counts > 0, np.maximum(counts, shingle), 0), shingle)
    first = first + np.repeat(at[:-1] - (np.cumsum(np.where(counts > 0, np.maximum(counts, shingle), 0)) - np.where(counts > 0, np.maximum(counts, shingle), 0)), n)
    last = np.minimum(first + shingle, at[1:][doc]) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[s:e], SEED) for s, e in zip(place[first].tolist(), stop[last].tolist(), strict=True)), K.U64, len(first))
    out, done = np.zeros(len(counts), K.U64), np.cumsum(n)
    before = done - n
    set_ = np.zeros((len(counts), 64), np.int64)
    for k in range(0, len(h), 1 << 16):  # bit sums of each document, a bounded number of rows at a time
        bits = np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        d = doc[k : k + (1 << 16)]
        cut = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        set_[d[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    majority = 2 * set_ > (done - before)[:, None]
    return np.packbits(majority, axis=1, bitorder="little").view(K.U64).reshape(-1) if len(counts) else out


def _hamming() -> tuple[np.ndarray, np.ndarray]:
    """For each 15-bit word: the nearest code word, and those nearest to a word one bit away (itself first, -1 for none)."""
    words = np.arange(1 << 15)
    syndrome = np.zeros(1 << 15, np.int64)
    for bit in range(15):
        syndrome ^= np.where(words >> bit & 1, bit + 1, 0)
    home = np.where(syndrome > 0, words ^ (1 << np.maximum(syndrome - 1, 0)), words)
    around = np.sort(np.stack([home, *(home[words ^ (1 << bit)] for bit in range(15))], 1), 1)
    around[:, 1:][around[:, 1:] == around[:, :-1]] = -1
    around = -np.sort(-around, 1)[:, :8]
    return home, around


_HOME, _AROUND = _hamming()


def replicas(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of fp, anchor, whether it is the home) of every replica."""
    row, anchor, home = [], [], []
    index = np.arange(len(fp))
    for k, (shift, width) in enumerate(BLOCKS):
        block = (fp >> K.U64(shift)).astype(np.int64) & ((1 << width) - 1)
        low, rest = block & 0x7FFF, block >> 15
        name = lambda code, rest, k=k: (k << 22) | (rest << 15) | code
        for column in _AROUND[low].T:
            ok = column >= 0
            row.append(index[ok])
            anchor.append(name(column[ok], rest[ok]))
            home.append(column[ok] == _HOME[low[ok]])
        for bit in range(width - 15):
            row.append(index)
            anchor.append(name(_HOME[low], rest ^ (1 << bit)))
            home.append(np.zeros(len(fp), bool))
    return np.concatenate(row), np.concatenate(anchor), np.concatenate(home)


class Forest:
    """Union-find by smallest label over the members of one partition."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            low = np.minimum(self.label[a], self.label[b])
            np.minimum.at(self.label, self.label[a], low)
            np.minimum.at(self.label, self.label[b], low)
            while True:  # follow labels to their ends
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up
            apart = self.label[a] != self.label[b]
            a, b = a[apart], b[apart]


def link(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the fingerprints that some anchor shows to be within threshold; rows come sorted by anchor."""
    names, member = np.unique(fp, return_inverse=True)
    forest = Forest(len(names))
    start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(anchor)))
    homes = np.flatnonzero(home)
    group = np.searchsorted(start, homes, "right") - 1
    pairs = size[group]
    large = pairs * np.bincount(group, minlength=len(start))[group] > 1 << 18 if len(group) else np.zeros(0, bool)
    small, of = homes[~large], group[~large]
    done = np.cumsum(size[of])
    k = 0
    while k < len(small):  # small groups: all home-member pairs, a bounded number at a time
        upto = max(k + 1, int(np.searchsorted(done, (done[k - 1] if k else 0) + (1 << 19), "right")))
        n = size[of[k:upto]]
        left = np.repeat(small[k:upto], n)
        right = np.repeat(start[of[k:upto]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        near = np.bitwise_count(fp[left] ^ fp[right]) <= threshold
        near &= member[left] != member[right]
        forest.add(member[left[near]], member[right[near]])
        k = upto
    for x, g in zip(homes[large].tolist(), group[large].tolist(), strict=True):  # large ones: a home against members that are not yet with it
        at = slice(start[g], start[g] + size[g])
        others = np.flatnonzero(forest.label[member[at]] != forest.label[member[x]]) + start[g]
        others = others[np.bitwise_count(fp[others] ^ fp[x]) <= threshold]
        forest.add(np.full(len(others), member[x]), member[others])
    joined = np.flatnonzero(forest.label != np.arange(len(names)))
    return names[joined], names[forest.label[joined]]


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) over distinct fingerprints fp that connect all within the threshold."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(K.U64)
            row, anchor, home = replicas(fp)
            for k in range(0, len(row), 100_000):
                s = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[s].astype(np.int64)), pa.array(fp[row[s]].view(np.int64)), pa.array(home[s])], ["anchor", "fp", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def emit():
            a, b = link(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for b in batches:
            anchor, fp, home = b.column(0).to_numpy(), b.column(1).to_numpy().view(K.U64), b.column(2).to_numpy(zero_copy_only=False)
            # whole anchors only: what came so far ends at the last change of anchor
            if sum(len(x[0]) for x in held) >= LINK_ROWS and (cut := np.flatnonzero(anchor != held[-1][0][-1])).size:
                c = cut[0]
                held.append((anchor[:c], fp[:c], home[:c]))
                yield emit()
                held = [(anchor[c:], fp[c:], home[c:])]
            elif len(anchor):
                held.append((anchor, fp, home))
        if held:
            yield emit()

    replicated = distinct.select("fp").mapInArrow(spread, "anchor long, fp long, home boolean")
    return split(replicated).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a long, b long")


def split(replicated: DataFrame) -> DataFrame:
    """Rows of anchors with more than HOT members dealt to a grid of s by s parts: homes by rows, members by columns, so
    that each home still meets each member in one part, and no part holds much more than twice HOT."""
    many = replicated.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT)
    rows = replicated.join(many.select("anchor", F.ceil(F.col("n") / HOT).alias("s")), "anchor", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("s"))
    side = lambda home: F.transform(F.sequence(F.lit(0).cast("long"), F.col("s") - 1), lambda k: F.struct((F.xxhash64("anchor", own, k) if home else F.xxhash64("anchor", k, own)).alias("anchor"), F.lit(home).alias("home")))
    none = F.slice(side(False), 1, 0)
    parts = F.when(F.col("s").isNull(), F.array(F.struct("anchor", "home"))).otherwise(F.concat(F.when(F.col("home"), side(True)).otherwise(none), side(False)))
    return rows.select("fp", F.explode(parts).alias("x")).select("x.anchor", "fp", "x.home")


def components(prints: DataFrame) -> DataFrame:
    """Adds root (the component's least fingerprint) and component_id to rows of doc_id and fp."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected(links(distinct))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = stored(named, "roots")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(named.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    return components(stored(fingerprints(docs), "prints"))


def filtered(docs: DataFrame) -> DataFrame:
    """One row of each component: that of the smallest doc_id, of repeated ids the smallest text's hash."""
    found = near_duplicates(docs)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("x"))
    keep = first.select(F.coalesce("x.doc_id", F.lit(int(K.NULL_ID))).alias("_id"), F.col("x.th").alias("_th"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(K.NULL_ID))).alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_th"))
    met = rows.join(keep, ["_id", "_th"], "left_semi")
    one = met.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_th").orderBy("_id")))
    return one.where("_n = 1").select("row.*")


def op7_simhash_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
