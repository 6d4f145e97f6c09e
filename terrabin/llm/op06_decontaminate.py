"""Benchmark decontamination with a broadcast set of benchmark windows.

Items become windows of WINDOW words (an item of fewer is one window).  A set holds the items' words once, and for
each different window its 64-bit hash, its place among them and the items that have it: some five times the text.
Documents stream through Arrow batches: rolling window hashes, a bitmap, a binary search, then each hit is compared
byte for byte with the benchmark's own window.

A benchmark of up to BROADCAST_BYTES of text is one set, and documents are not shuffled.  A larger one is dealt to
parts by measured size, each below the bound (an item beyond it is a part of its own); every part scans the documents
in tasks of its own, and only the rows that it hits are united, by doc_id and two hashes of the text.

Edge cases: null texts have no words; items without words have no windows; an item without an id still marks
words but is not named; repeated rows stay repeated rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .session import prepare, stored, table

WINDOW = 13
#: Benchmark text of which one broadcast set is made.
BROADCAST_BYTES = 16 << 20
#: Contaminated from this share of hit words on.
SHARE = 20

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Spark's pattern for the same words, in text not lower-cased.
_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes compared at a time.
COMPARED = 8 << 20


class Words:
    """The words of some texts: their hashes, and the words themselves joined by single spaces."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        buf = LOWER[raw]
        starts, ends, self.at = K.runs(WORD[buf], offsets)
        self.counts = np.diff(self.at)
        self.hashes = K.Poly(K.byte_values(buf)).of(starts, ends)
        size = ends - starts
        self.place = np.cumsum(size + 1) - size - 1
        self.stop = self.place + size
        self.joined = np.full(int((size + 1).sum()), 32, np.uint8)
        src = np.flatnonzero(WORD[buf])
        self.joined[np.repeat(self.place - starts, size) + src] = buf[src]
        self.grams = K.Poly(self.hashes)

    def windows(self, n: int, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, text and hash of every window of n words, by counts of words other than the texts' own if given."""
        counts = self.counts if counts is None else counts
        w, text = K.windows(counts, n)
        w = w - np.repeat((np.cumsum(counts) - counts - self.at[:-1]), np.maximum(counts - n + 1, 0))
        return w, text, self.grams.of(w, w + n)

    def bytes_of(self, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of windows of n words in joined."""
        return self.place[w], self.stop[w + n - 1] - self.place[w]


def same(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[at:at+size] equals b[bt:bt+size], for many at once."""
    out, done, k = np.zeros(len(size), bool), np.cumsum(size), 0
    while k < len(size):
        upto = max(k + 1, int(np.searchsorted(done, (done[k - 1] if k else 0) + COMPARED, "right")))
        n = size[k:upto].astype(np.int64)
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum()))
        equal = a[np.repeat(at[k:upto] - first, n) + step] == b[np.repeat(bt[k:upto] - first, n) + step]
        out[k:upto] = np.logical_and.reduceat(equal, first)
        k = upto
    return out


class Table:
    """Different windows of n words by hash, and the items that hold each."""

    def __init__(self, n: int, hashes: np.ndarray, begin: np.ndarray, size: np.ndarray, first: np.ndarray, items: np.ndarray):
        self.n, self.hashes, self.begin, self.size, self.first, self.items = n, hashes, begin.astype(np.uint32), size.astype(np.uint32), first.astype(np.uint32), items.astype(np.uint32)
        self.bits = min(24, max(10, 2 + int(len(hashes)).bit_length()))
        self.bitmap = np.zeros(1 << self.bits, bool)
        self.bitmap[hashes >> K.U64(64 - self.bits)] = True

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.hashes, self.begin, self.size, self.first, self.items, self.bitmap))

    def found(self, words: Words, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, document and entry of the windows of words that stand here; text: the set's own."""
        w, doc, h = words.windows(self.n)
        at = np.flatnonzero(self.bitmap[h >> K.U64(64 - self.bits)])
        entry = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        ok = self.hashes[entry] == h[at]
        at, entry = at[ok], entry[ok]
        begin, size = words.bytes_of(w[at], self.n)
        alike = np.flatnonzero(size == self.size[entry])
        alike = alike[same(words.joined, begin[alike], text, self.begin[entry[alike]].astype(np.int64), size[alike])]
        return w[at[alike]], doc[at[alike]], entry[alike]


class WindowSet:
    """The windows of some items."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.names = sorted({str(i) for i, _ in items if i is not None})
        index = {x: k for k, x in enumerate(self.names)}
        own = np.array([index[str(i)] if i is not None else len(self.names) for i, _ in items], np.int64)
        texts, rows, before = [], {}, 0
        for i, j, raw, offsets in K.text_slices(pa.array([t for _, t in items], pa.large_string())):
            words = Words(raw, offsets)
            length = np.minimum(words.counts, window)
            for n in np.unique(length[length > 0]).tolist():
                w, doc, h = words.windows(n, np.where(length == n, words.counts, 0))
                begin, size = words.bytes_of(w, n)
                rows.setdefault(n, []).append((h, begin + before, size, own[i:j][doc]))
            texts.append(words.joined)
            before += len(words.joined)
        self.text = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
        self.tables: list[Table] = []
        for n, parts in sorted(rows.items()):
            self._add(n, *(np.concatenate(x) for x in zip(*parts, strict=True)))

    def _add(self, n: int, h: np.ndarray, begin: np.ndarray, size: np.ndarray, item: np.ndarray) -> None:
        order = np.lexsort((item, h))
        h, begin, size, item = h[order], begin[order], size[order], item[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        head = np.repeat(first, np.diff(np.append(first, len(h))))
        equal = size == size[head]
        equal[equal] = same(self.text, begin[equal], self.text, begin[head][equal], size[equal])
        if not equal.all():  # other windows of the same hash get a table of their own
            self._add(n, *(x[~equal] for x in (h, begin, size, item)))
        kept = equal & np.r_[True, (head[1:] != head[:-1]) | (item[1:] != item[:-1])]
        bounds = np.append(np.searchsorted(head[kept], first), int(kept.sum()))
        self.tables.append(Table(n, h[first], begin[first], size[first], bounds, item[kept]))

    def nbytes(self) -> int:
        return self.text.nbytes + sum(t.nbytes() for t in self.tables) + sum(60 + len(x) for x in self.names)

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are hit, and the different pairs of document and item."""
        gone, pairs = np.zeros(len(words.hashes), bool), [np.zeros(0, np.int64)]
        for t in self.tables:
            w, doc, entry = t.found(words, self.text)
            if len(w):
                gone |= K.covered(len(gone), w, t.n)
                met = np.unique(doc * len(t.hashes) + entry)
                doc, entry = met // len(t.hashes), met % len(t.hashes)
                n = (t.first[entry + 1] - t.first[entry]).astype(np.int64)
                item = t.items[np.repeat(t.first[entry].astype(np.int64) - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                pairs.append(np.unique(np.repeat(doc, n) * (len(self.names) + 1) + item))
        both = np.unique(np.concatenate(pairs))
        doc, item = both // (len(self.names) + 1), both % (len(self.names) + 1)
        return gone, doc[item < len(self.names)], item[item < len(self.names)]


FOUND = "n_words long, spans array<array<int>>, items array<string>"


def scan(rows: DataFrame, items: list, window: int = WINDOW, hit_only: bool = False) -> DataFrame:
    """Adds n_words, spans and items to rows of (row, text); no shuffle."""
    shared = prepare(rows.sparkSession).sparkContext.broadcast(WindowSet(items, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            for i, j, raw, offsets in K.text_slices(b.column(1)):
                words = Words(raw, offsets)
                gone, doc, item = known.hits(words)
                starts, ends, own = K.runs(gone, words.at)
                spans = [[] for _ in range(j - i)]
                names = [[] for _ in range(j - i)]
                for d in np.flatnonzero(np.diff(own)).tolist():
                    s = slice(own[d], own[d + 1])
                    spans[d] = np.stack([starts[s], ends[s]], 1) - words.at[d]
                    spans[d] = spans[d].tolist()
                for d, k in zip(doc.tolist(), item.tolist(), strict=True):
                    names[d].append(known.names[k])
                out = pa.RecordBatch.from_arrays(
                    [b.column(0)[i:j], b.column(1)[i:j], pa.array(words.counts.astype(np.int64)), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(names, pa.list_(pa.string()))],
                    ["row", "text", "n_words", "spans", "items"],
                )
                yield out.filter(pa.array(np.diff(own) > 0)) if hit_only else out

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *T._parse_datatype_string(FOUND).fields]))


def dealt(benchmark: DataFrame, limit: int) -> tuple[DataFrame, list[list[int]]]:
    """The different items with a bucket each, and parts as lists of buckets of at most limit bytes together."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    total = int(items.agg(F.sum(size)).first()[0] or 0)
    items = items.withColumn("bucket", F.pmod(F.xxhash64("text", F.col("item_id").cast("string")), F.lit(8 * (total // limit) + 1)))
    parts, room = [[]], limit
    for r in items.groupBy("bucket").agg(F.sum(size).alias("n")).orderBy("bucket").collect() if total > limit else []:
        if parts[-1] and r["n"] > room:
            parts.append([])
            room = limit
        parts[-1].append(r["bucket"])
        room -= r["n"]
    return items, parts


def hits(docs: DataFrame, benchmark: DataFrame, columns: list[str] | None = None, window: int = WINDOW, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(row, text, n_words, spans of word offsets, item names) of every document; row has its columns, all by default."""
    kept = docs.columns if columns is None else columns
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), text.alias("text"))
    items, parts = dealt(benchmark, limit)
    if len(parts) == 1:
        return scan(rows, [tuple(r) for r in items.select("item_id", "text").collect()], window)
    key = lambda t: F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(t).alias("a"), F.xxhash64(F.lit(1), t).alias("b"))
    items, keyed, found = stored(items, "items"), docs.select(key(text).alias("row"), text.alias("text")), []
    for part in parts:
        own = [tuple(r) for r in items.where(F.col("bucket").isin(part)).select("item_id", "text").collect()]
        met = scan(keyed, own, window, True).drop("text")
        found.append(met.groupBy("row").agg(F.first("spans").alias("spans"), F.first("items").alias("items")))  # equal rows have equal hits
    both = reduce(DataFrame.unionByName, found).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    both = both.select(F.col("row").alias("key"), _merged("spans").alias("spans"), "items")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), text.alias("text"), key(text).alias("own")).join(both, F.col("own").eqNullSafe(F.col("key")), "left")
    n_words = F.coalesce(F.regexp_count("text", F.lit(_WORDS)), F.lit(0)).cast("long")
    return rows.select("row", "text", n_words.alias("n_words"), F.coalesce("spans", F.expr("cast(array() as array<array<int>>)")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def _merged(spans: str):
    """Sorted spans with those that meet united."""
    last = lambda out: F.element_at(out, -1)
    grown = lambda out, s: F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.array(F.get(last(out), 0), F.greatest(F.get(last(out), 1), F.get(s, 1)))))
    none = F.expr("cast(array() as array<array<int>>)")
    return F.aggregate(F.array_sort(spans), none, lambda out, s: F.when((F.size(out) > 0) & (F.get(s, 0) <= F.coalesce(F.get(F.try_element_at(out, F.lit(-1)), 1), F.lit(-1))), grown(out, s)).otherwise(F.concat(out, F.array(s))))


def _contaminated():
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (F.get(s, 1) - F.get(s, 0)))
    return n_hit, (n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))


def digest(found: DataFrame) -> DataFrame:
    n_hit, bad = _contaminated()
    names = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), bad.alias("contaminated"))


def filtered(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, unchanged."""
    return hits(docs, benchmark).where(~_contaminated()[1]).select("row.*")


def without_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with the words of all hits cut out of their texts (words by the operator's own rule; the rest unchanged)."""
    found = hits(docs, benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if spans:
                    raw = (text or "").encode()
                    starts, ends, _ = K.runs(WORD[LOWER[np.frombuffer(raw, np.uint8)]], np.array([0, len(raw)]))
                    keep = np.ones(len(raw), bool)
                    for s, e in spans:
                        keep[starts[s] : ends[e - 1]] = False
                    text = np.frombuffer(raw, np.uint8)[keep].tobytes().decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["row", "cut"])

    cut = found.mapInArrow(run, T.StructType([found.schema["row"], T.StructField("cut", T.StringType())]))
    return cut.select(*(F.col("cut").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"]))


SQL = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents),
i as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark),
iw as (
  select distinct item_id, least(13, len(w)) as n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') as g
  from (select item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) as s from i where len(w) > 0)),
dw as (
  select doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as s from w cross join (select distinct n from iw) where len(w) >= n)),
h as (select doc_id, s, n, item_id from dw join iw using (n, g)),
p as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(generate_series(s, s + n - 1)) as k from h) group by doc_id),
m as (select doc_id, count(*) as n_items, string_agg(t, ',' order by t) as ids from (select distinct doc_id, cast(item_id as varchar) as t from h) group by doc_id)
select w.doc_id, cast(len(w.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w.w) as contaminated
from w left join p using (doc_id) left join m using (doc_id)
"""
