"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them).  A pattern offers its words
once at cost 0 and each further time at a higher cost (convex), at most MAX_REPEATS times in all; sources ask for
their quotas.  Patterns that share sources, directly or by others, form a component; successive shortest paths route
the words of each component in a task of its own, over its patterns, never over documents.  A pattern that shares no
source is a flow of one arc and is settled by an expression.

What a pattern owes is met by whole copies of all its documents, and by documents in the order of a seeded hash up to
the rest.  The document at which the rest is reached is taken whole or left, whichever is nearer, if that moves the
pattern by at most 1 in SLACK of what it owes; otherwise the mix takes its first words.

The order is never materialised: words by (pattern, first 12 hash bits), then by the next 12 bits within the bucket
where the rest is reached, then by the whole hash in that bucket, find the hash at which the rest is reached; a source
with a third of all rows is therefore summed by partial aggregation, not sorted in one task.  Sources are ranked by
range partitions, and targets found by rounds of one aggregate over the table of sources; the driver holds numbers only.

Edge cases: a null text has size 0; a null source is a source of its own, sorted last, and so is a null or empty
membership; documents of size 0 take 0; an empty table gives an empty result; rows of equal id and text share a place
and share what is taken there alike, to a word each; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict, deque
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import connected
from .session import prepare, stored, table

MAX_REPEATS, SEED, SLACK = 2, 20240, 1000
WEIGHTS, SHARE = (3, 1, 2), Fraction(3, 2)
#: Tables of patterns or sources up to so many bytes are broadcast.
BROADCAST_BYTES = 16 << 20
_WORD = r"[^\x20\x09-\x0D]+"


def flow(patterns: dict[tuple, int], quotas: dict, most: int = MAX_REPEATS) -> dict[tuple, int]:
    """Words that each pattern gives: a min-cost maximum flow from patterns to sources, by successive shortest paths."""
    start, end = ("start",), ("end",)
    to, cap, cost, out = [], [], [], defaultdict(list)

    def arc(a, b, c, w):
        for x, y, cc, ww in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(cc)
            cost.append(ww)

    for p, size in patterns.items():
        for k in range(most):
            arc(start, ("p", p), size, k * k)
        for s in p:
            arc(("p", p), ("s", s), size * most, 0)
    for s in {s for p in patterns for s in p}:
        arc(("s", s), end, int(quotas.get(s, 0)), 0)
    while True:
        far, via, queue, inside = {start: 0}, {}, deque([start]), {start}
        while queue:
            a = queue.popleft()
            inside.discard(a)
            for e in out[a]:
                if cap[e] and (d := far[a] + cost[e]) < far.get(to[e], 1 << 60):
                    far[to[e]], via[to[e]] = d, e
                    if to[e] not in inside:
                        inside.add(to[e])
                        queue.append(to[e])
        if end not in far:
            break
        path, at = [], end
        while at != start:
            path.append(via[at])
            at = to[via[at] ^ 1]
        least = min(cap[e] for e in path)
        for e in path:
            cap[e] -= least
            cap[e ^ 1] += least
    given = dict.fromkeys(patterns, 0)
    for e in out[start]:
        if not e & 1:
            given[to[e][1]] += cap[e ^ 1]
    return given


def placed(docs: DataFrame, members: str | None = None) -> DataFrame:
    """(row, sources, size, place in the seeded order) of every document; row has all its columns.

    members: a column of arrays of sources; without it each document belongs to its source alone."""
    prepare(docs.sparkSession)
    text, none = F.col("text").cast("string"), F.array(F.lit(None).cast("string"))
    held = F.array(F.col("source").cast("string")) if members is None else F.array_sort(F.array_distinct(F.col(members).cast("array<string>")))
    held = F.when(F.coalesce(F.size(held), F.lit(0)) > 0, held).otherwise(none)
    size = F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")
    place = F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long"), text).bitwiseAND(F.lit((1 << 62) - 1))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select(row.alias("row"), held.alias("sources"), size.alias("size"), place.alias("place"))


def beside(df: DataFrame, name: str) -> DataFrame:
    """A table with an array or string column name, marked for broadcast if its measured size allows that."""
    text = F.array_join(name, "", "") if df.schema[name].dataType.typeName() == "array" else F.col(name)
    n = df.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 100)).first()[0] or 0
    return F.broadcast(df) if n <= BROADCAST_BYTES else df


def ranked(sizes: DataFrame) -> DataFrame:
    """Adds rank, from 0 by code point, nulls last: rows number within range partitions, to which the counts before are added."""
    order = F.col("source").asc_nulls_last()
    ranged = stored(sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("part").count()
    before = counts.withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count")).drop("count")  # a row a partition
    number = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return ranged.withColumn("number", number).join(F.broadcast(before), "part").select("source", "size", (F.col("before") + F.col("number")).alias("rank"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: Fraction = SHARE, most: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, rank, target, quota): share of all sizes by weight; targets stop at most times the source's
    size and the excess is reshared.  Full sources are those that the unit of a round lifts above that; the unit only
    rises, so each round needs one aggregate."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = stored(ranked(sizes).withColumn("weight", weight), "sources")
    total, open_ = rows.agg(F.sum("size"), F.sum("weight")).first()
    total, open_ = int(total or 0), int(open_ or 0)
    whole = lambda x: x.cast("decimal(38,0)")
    left = share.numerator * total  # the words left, times share's denominator
    while True:
        unit = (left, share.denominator * open_)
        full = whole(F.col("weight")) * F.lit(unit[0]).cast("decimal(26,0)") > whole(F.col("size") * most) * F.lit(unit[1]).cast("decimal(18,0)") if open_ else F.lit(True)
        capped, still = rows.agg(F.sum(F.when(full, F.col("size") * most)), F.sum(F.when(~full, F.col("weight")))).first()
        capped, still = int(capped or 0), int(still or 0)
        if still == open_:
            break
        left, open_ = share.numerator * total - share.denominator * capped, still
    top = F.col("size") * most
    by_unit = F.col("weight") * F.lit(unit[0]).cast("decimal(26,0)")
    target = F.when(full, top.cast("double")).otherwise(by_unit.cast("double") / F.lit(float(max(unit[1], 1))))
    quota = F.when(full, top).otherwise(F.floor(target + 0.5).cast("long"))
    return rows.select("source", F.col("size").alias("source_size"), "rank", target.alias("target"), quota.alias("quota"))


def given(patterns: DataFrame, goals: DataFrame, most: int = MAX_REPEATS) -> DataFrame:
    """(sources, size, given): the words that each pattern gives."""
    alone = F.least(F.col("size") * most, F.col("quota"))
    held = patterns.withColumn("source", F.explode("sources"))
    held = held.join(beside(goals.select(F.col("source").alias("s"), "rank", "quota"), "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    if patterns.where(F.size("sources") > 1).isEmpty():
        return held.select("sources", "size", alone.alias("given"))
    held = stored(held, "held")
    first = held.groupBy("sources").agg(F.min("rank").alias("a"))
    edges = held.join(first, held.sources.eqNullSafe(first.sources)).select("a", F.col("rank").alias("b"))
    roots = connected(edges).select(F.col("node").alias("rank"), "root")
    held = held.join(roots, "rank", "left")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = {tuple(s): int(n) for s, n in zip(rows["sources"], rows["size"], strict=True)}
        out = flow(sizes, {s: int(q) for names, quotas in zip(rows["sources"], rows["quotas"], strict=True) for s, q in zip(names, quotas, strict=True)}, most)
        return pd.DataFrame({"sources": [list(p) for p in sizes], "size": list(sizes.values()), "given": [out[p] for p in sizes]})

    # quotas in the order of sources: code points, nulls last, as ranks go
    by_pattern = held.where("root is not null").groupBy("sources", "size").agg(F.min("root").alias("root"), F.transform(F.sort_array(F.collect_list(F.struct("rank", "quota"))), lambda x: x["quota"]).alias("quotas"))
    shared = by_pattern.groupBy("root").applyInPandas(solve, "sources array<string>, size long, given long")
    return held.where("root is null").select("sources", "size", alone.alias("given")).unionByName(shared)


def cuts(rows: DataFrame, owed: DataFrame) -> DataFrame:
    """(of, repeats, cut, there): how often the pattern's documents are taken whole, the place up to which they are once
    more, and the words that each row at that place gives (-1: all)."""
    n, g = F.col("size"), F.col("given")
    owed = owed.select(F.col("sources").alias("of"), "given", F.when(n > 0, F.expr("given div size")).otherwise(0).alias("repeats"), F.when(n > 0, g % n).otherwise(0).alias("rest"))
    owed = beside(stored(owed, "owed"), "of")
    same = F.col("sources").eqNullSafe(F.col("of"))

    def reached(sums: DataFrame, at: str) -> DataFrame:
        """Of (sources, at, words, rest): where the running words reach the rest, and what is left of it there."""
        s = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("sources").orderBy(at)))
        s = s.where((F.col("upto") - F.col("words") < F.col("rest")) & (F.col("upto") >= F.col("rest")))
        return s.select(F.col("sources").alias("of"), F.col(at).alias("edge"), (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"), "words", "copies")

    sums = (F.sum("size").alias("words"), F.count(F.lit(1)).alias("copies"))
    one = rows.withColumn("b", F.shiftright("place", 50)).groupBy("sources", "b").agg(*sums)
    edge = reached(one.join(owed, same).drop("of"), "b")
    for shift in (38, 0):  # 12 bits more of the place, then the whole place: each within the bucket found before
        wide = 50 if shift else 38
        edge = beside(stored(edge, "edge"), "of").drop("words", "copies")
        inner = rows.join(edge, same & (F.shiftright("place", wide) == F.col("edge")))
        inner = inner.withColumn("b", F.shiftright("place", shift)).groupBy("sources", "b").agg(*sums, F.max("rest").alias("rest"))
        edge = reached(inner, "b")
    edge = edge.withColumnRenamed("of", "sources")
    met = owed.drop("rest").join(edge, same, "left").drop("sources")
    near = SLACK * F.least(F.col("rest"), F.col("words") - F.col("rest")) <= F.col("given")
    there = F.when(near, F.when(2 * F.col("rest") >= F.col("words"), -1).otherwise(0)).otherwise(F.expr("rest div copies"))
    return met.select("of", "repeats", F.coalesce("edge", F.lit(-1)).alias("cut"), F.coalesce(there, F.lit(0)).alias("there"))


def taken(rows: DataFrame, slim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with taken; the targets.  slim: the same rows without texts."""
    patterns = stored(slim.groupBy("sources").agg(F.sum("size").alias("size")), "patterns")
    held = patterns.select(F.explode("sources").alias("source"), "size")
    goals = stored(targets(held.groupBy("source").agg(F.sum("size").alias("size"))), "targets")
    plan = beside(stored(cuts(slim, given(patterns, goals)), "cuts"), "of")
    at = F.when(F.col("there") < 0, F.col("size")).otherwise(F.least("size", "there"))
    more = F.when(F.col("place") < F.col("cut"), F.col("size")).when(F.col("place") == F.col("cut"), at).otherwise(F.lit(0))
    out = rows.join(plan, F.col("sources").eqNullSafe(F.col("of"))).drop("of")
    return out.withColumn("taken", F.col("size") * F.col("repeats") + more).drop("repeats", "cut", "there"), goals


def mixed(docs: DataFrame, members: str | None = None) -> tuple[DataFrame, DataFrame]:
    """doc_id, sources, size and taken of every document, and (source, source_size, rank, target, quota); texts are read once."""
    rows = placed(docs.select("doc_id", "text", "source" if members is None else members), members)
    slim = stored(rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), "sources", "size", "place"), "sizes")
    out, goals = taken(slim, slim)
    return out.select("doc_id", "sources", "size", "taken"), goals


def repeated(docs: DataFrame, members: str | None = None) -> DataFrame:
    """The mix itself: rows of docs as often as they are taken, unchanged; where a document had to be cut to meet a
    target, that row's text is its first words, joined by spaces."""
    rows = placed(docs, members)
    slim = stored(rows.select("sources", "size", "place"), "sizes")
    out = taken(rows, slim)[0].where("taken > 0")
    whole, part = F.expr("cast(taken div size as int)"), F.expr("cast(taken % size as int)")
    times = F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.expr("cast(array() as array<int>)")))
    out = out.withColumn("first", F.explode(times))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text").cast("string"), F.lit(_WORD), 0), F.lit(1), F.col("first")), " ")
    text = F.when(F.col("first") > 0, cut).otherwise(F.col("row.text").cast("string"))
    new = {"text": text, "n_chars": F.when(F.col("first") > 0, F.char_length(cut).cast("long")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def by_source(docs: DataFrame) -> DataFrame:
    """mixed() where each document has one source: with that source, its size and its target."""
    out, goals = mixed(docs)
    info = beside(goals.select(F.col("source").alias("s"), "source_size", "target"), "s")
    out = out.withColumn("source", F.get("sources", F.lit(0)))
    return out.join(info, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", "taken")


def op10_flow_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_source(table(spark, sf_dir, "documents"))


def mix_overlapping_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix where a document belongs to its source and to its language's collection, so that patterns overlap."""
    docs = table(spark, sf_dir, "documents")
    names: list[Column] = [F.concat(F.lit("source:"), "source"), F.concat(F.lit("lang:"), "lang")]
    return mixed(docs.withColumn("members", F.array(*names)), "members")[0].withColumn("sources", F.array_join("sources", ",", "null"))
