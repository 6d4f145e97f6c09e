"""Quality rules as a learned decision list.

Statistics of every whole text are computed in numpy over Arrow batches.  A bounded, hash-chosen sample of
labelled rows (FIT_ROWS) goes to the driver, where sequential covering grows conjunctions of thresholds by
information gain on two thirds, prunes them on the last third, and stops when a rule no longer beats the base
rate.  The result is an ordered list, emitted as one Spark CASE expression.

Edge cases: a null or empty text has no words, and fails the base rule; null ids and repeated rows are kept as
they are, and of rows that share a labelled id the one of least statistics trains; without labels the list is empty and only the base rule rejects; further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .session import prepare, table

#: At most so many labelled rows train the list, the smallest by hash of doc_id.
FIT_ROWS = 20_000
#: Words of the learned vocabulary: at most so many, each after so many different words, bad documents' share of its uses.
CUE_WORDS, CUE_SUPPORT, CUE_PRECISION = 200, 12, 0.95
MIN_PRECISION, MIN_COVER, MAX_RULES, MAX_TERMS = 0.9, 10, 24, 4

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_digits", "n_chars", "n_punct_end", "n_distinct", "top_words", "n_cues")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A cue word is a run of ASCII letters (lower-cased) and non-ASCII characters.
LETTER = np.zeros(256, bool)
LETTER[[*range(97, 123), *range(128, 256)]] = True
RATIOS = {
    "mean_word": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_ratio": ("n_repeat_words", "n_words"), "upper_ratio": ("n_upper", "n_chars"), "digit_ratio": ("n_digits", "n_chars"),
    "distinct_ratio": ("n_distinct", "n_words"), "top_ratio": ("top_words", "n_words"), "words_per_line": ("n_words", "n_lines"),
    "sentence_ratio": ("n_punct_end", "n_words"),
}
FEATURES = ("n_words", *RATIOS, "n_cues")


def slice_stats(buf: np.ndarray, offsets: np.ndarray, cues: frozenset[bytes] = frozenset()) -> dict[str, np.ndarray]:
    """The statistics of each document in one slice."""
    n = len(offsets) - 1
    starts, ends, at = K.runs(~K.SPACE[buf], offsets)
    counts = np.diff(at)
    poly = K.Poly(K.byte_values(buf))
    word = poly.of(starts, ends)
    doc = np.repeat(np.arange(n), counts)
    lead = (buf & 0xC0) != 0x80
    out = {"n_words": counts, "n_chars": K.per_doc(lead, offsets), "word_chars": K.per_doc(lead & ~K.SPACE[buf], offsets), "n_symbols": K.per_doc(SYMBOLS[buf], offsets)}
    out["n_upper"] = K.per_doc((buf >= 65) & (buf <= 90), offsets)
    out["n_digits"] = K.per_doc((buf >= 48) & (buf <= 57), offsets)
    stop = np.isin(buf[ends - 1], list(b".!?")) if len(ends) else np.zeros(0, bool)
    out["n_punct_end"] = K.per_doc(stop, at)
    # lines: runs between \n, with a word, equal to an earlier one
    ls, le, _ = K.runs(buf != 10, offsets)
    has = np.searchsorted(starts, le) > np.searchsorted(ends, ls, "right")
    ls, le = ls[has], le[has]
    line_doc = np.searchsorted(offsets, ls, "right") - 1
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    order, first = K.groups(K.mix(poly.of(ls, le) + line_doc.astype(K.U64) * K.U64(0x9E3779B97F4A7C15)))
    again = np.ones(len(ls), bool)
    again[first] = False
    out["n_dup_lines"] = np.bincount(line_doc[order][again], minlength=n)
    # 8-word windows met twice or more in a text
    w, wdoc = K.windows(counts, 8)
    grams = K.Poly(word)
    order, first = K.groups(K.mix(grams.of(w, w + 8) + wdoc.astype(K.U64) * K.U64(0x9E3779B97F4A7C15)))
    size = np.diff(np.append(first, len(w)))
    repeated = w[order][np.repeat(size > 1, size)]
    out["n_repeat_words"] = K.per_doc(K.covered(len(word), repeated, 8), at)
    # distinct words, and how often the commonest comes
    order, first = K.groups(K.mix(word + doc.astype(K.U64) * K.U64(0x9E3779B97F4A7C15)))
    size = np.diff(np.append(first, len(word)))
    owner = doc[order][first]
    out["n_distinct"] = np.bincount(owner, minlength=n)
    out["top_words"] = np.zeros(n, np.int64)
    np.maximum.at(out["top_words"], owner, size)
    out["n_cues"] = np.zeros(n, np.int64)
    if cues:
        low = LOWER[buf]
        ls, le, lat = K.runs(LETTER[low], offsets)
        hit = np.flatnonzero(np.isin(K.Poly(K.byte_values(low)).of(ls, le), cue_hashes(cues)))
        hit = [i for i in hit if low[ls[i] : le[i]].tobytes() in cues]
        np.add.at(out["n_cues"], np.searchsorted(lat, hit, "right") - 1, 1)
    return out


def cue_hashes(cues: frozenset[bytes]) -> np.ndarray:
    joined = np.frombuffer(b"".join(cues), np.uint8)
    ends = np.cumsum([len(c) for c in cues])
    return K.Poly(K.byte_values(joined)).of(ends - np.array([len(c) for c in cues]), ends)


def stats(docs: DataFrame, cues: frozenset[str] = frozenset(), columns: list[str] | None = None) -> DataFrame:
    """The statistics of every document beside its row (a struct of its columns, all by default); no shuffle."""
    cues = frozenset(c.encode() for c in cues)
    kept = docs.columns if columns is None else columns
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, offsets in K.text_slices(b.column(1)):
                s = slice_stats(buf, offsets, cues)
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], *(pa.array(s[c].astype(np.int64)) for c in BASE + MORE)], ["row", *BASE, *MORE])

    prepare(docs.sparkSession)
    schema = T.StructType([named.schema["row"], *(T.StructField(c, T.LongType()) for c in BASE + MORE)])
    return named.mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """Reject where every (feature, '>' or '<=', threshold) holds."""

    terms: tuple[tuple[str, str, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        ok = np.ones(len(next(iter(x.values()))), bool)
        for f, op, t in self.terms:
            ok &= (x[f] > t) if op == ">" else (x[f] <= t)
        return ok

    def column(self) -> Column:
        c = F.lit(True)
        for f, op, t in self.terms:
            v = feature(f)
            c = c & ((v > F.lit(t)) if op == ">" else (v <= F.lit(t)))
        return c


def feature(name: str) -> Column:
    if name in RATIOS:
        a, b = RATIOS[name]
        return F.col(a) / F.greatest(F.col(b), F.lit(1)).cast("double")
    return F.col(name).cast("double")


def learn(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray) -> list[Rule]:
    """Sequential covering over (features, label, grow fold)."""
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < MAX_RULES and (bad & left).any():
        grow, prune = left & fold, left & ~fold
        terms: tuple = ()
        on = grow.copy()
        while len(terms) < MAX_TERMS and (on & ~bad).any():
            p, t = (on & bad).sum(), on.sum()
            best = (0.0, None)
            for f in FEATURES:
                values = np.unique(np.quantile(x[f][on], np.linspace(0, 1, 33)[1:-1])) if on.any() else []
                for v in values:
                    for op in (">", "<="):
                        s = on & ((x[f] > v) if op == ">" else (x[f] <= v))
                        p1, t1 = (s & bad).sum(), s.sum()
                        if p1 >= MIN_COVER:
                            gain = p1 * (np.log2(p1 / t1) - np.log2(max(p, 1) / t))
                            if gain > best[0] + 1e-9:
                                best = (gain, (f, op, float(v)))
            if best[1] is None:
                break
            terms += (best[1],)
            on &= Rule((best[1],)).holds(x)
        if not terms:
            break

        def worth(r: Rule) -> float:
            h = r.holds(x) & prune
            return ((h & bad).sum() - (h & ~bad).sum()) / max(h.sum(), 1) if h.any() else -1.0

        rule = max((Rule(terms[:k]) for k in range(len(terms), 0, -1)), key=worth)
        h = rule.holds(x) & left
        if (h & bad & prune).sum() < 1 or (h & bad).sum() < MIN_PRECISION * h.sum() or (h & bad).sum() < MIN_COVER:
            break
        rules.append(rule)
        left &= ~h
    return rules


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...] = ()
    cues: frozenset[str] = frozenset()

    def rejected(self) -> Column:
        """Index of the first rule that holds, or null: an ordered Spark CASE."""
        c = F.lit(None).cast("int")
        for i in reversed(range(len(self.rules))):
            c = F.when(self.rules[i].column(), F.lit(i)).otherwise(c)
        return c

    def describe(self) -> str:
        return json.dumps([[list(t) for t in r.terms] for r in self.rules])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DecisionList:
    """Learns from at most rows labelled documents; bad are those of quality 0 or marked toxic.  Two thirds of them
    grow rules and teach cue words, the others prune."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad")).where("doc_id is not null")
    marked = marked.groupBy("doc_id").agg(F.max("bad").alias("bad")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    marked = marked.withColumn("grow", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(3)) != 0)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marked), "doc_id")
    cues = _cues(picked.where("grow"))
    # statistics of one row an id, so that at most rows rows reach the driver however often an id comes
    found = stats(picked, cues, ["doc_id", "bad", "grow"]).select("row.doc_id", F.struct("row.bad", "row.grow", *BASE, *MORE).alias("x"))
    sample = found.groupBy("doc_id").agg(F.min("x").alias("x")).select("doc_id", "x.*").toPandas().sort_values("doc_id")
    if sample.empty:
        return DecisionList()
    return DecisionList(tuple(_train(sample)), cues)


def _features(s) -> dict[str, np.ndarray]:
    x = {c: s[c].to_numpy(float) for c in BASE + MORE}
    return {f: (x[RATIOS[f][0]] / np.maximum(x[RATIOS[f][1]], 1) if f in RATIOS else x[f]) for f in FEATURES}


def _train(sample) -> list[Rule]:
    return learn(_features(sample), sample["bad"].to_numpy(bool), sample["grow"].to_numpy(bool))


def _cues(picked: DataFrame) -> frozenset[str]:
    """Words that nearly only bad documents hold, after CUE_SUPPORT different words: a group of copies has one context."""
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = picked.select("bad", F.split(low, r"[^a-z\x{80}-\x{10FFFF}]+").alias("w"))
    n = words.select("bad", F.explode("w").alias("w")).where(F.length("w") > 2).groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("b"))
    n = n.where((F.col("b") >= CUE_SUPPORT) & (F.col("b") >= CUE_PRECISION * F.col("n")))
    pairs = words.where("bad").select(F.explode(F.arrays_zip("w", F.concat(F.array(F.lit("")), "w").alias("last"))).alias("p")).select("p.*").where(F.length("w") > 2)
    contexts = pairs.groupBy("w", "last").count().groupBy("w").agg(F.count(F.lit(1)).alias("contexts"))
    n = n.join(contexts, "w").where(F.col("contexts") >= CUE_SUPPORT)
    return frozenset(r.w for r in n.orderBy(F.desc("contexts"), "w").limit(CUE_WORDS).collect())


def judged(docs: DataFrame, model: DecisionList, columns: list[str] | None = None) -> DataFrame:
    """Row, statistics and verdict of every document."""
    s = stats(docs, model.cues, columns)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    s = s.withColumn("base_failed", failed).withColumn("rule", model.rejected())
    return s.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def filtered(docs: DataFrame, model: DecisionList) -> DataFrame:
    """The rows of docs that are kept."""
    return judged(docs, model).where("kept").select("row.*")


def op2_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return judged(docs, model, ["doc_id"]).select(F.col("row.doc_id").cast("long").alias("doc_id"), *BASE, "base_failed", "kept", "rule")
