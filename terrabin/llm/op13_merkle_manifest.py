"""A Merkle manifest of documents: a tree of 16 children a node over each source's leaves, and one over the sources' roots.

Leaves are hashed by SQL functions, stored without texts, and dealt to ranges of (source, doc_id).  From one summary row a
range the driver knows every range's place in its trees and the number of leaves (the arity) of trees that cross ranges.
A range turns its leaves into a fragment: the nodes, keyed by tree, level and index, whose sibling run it does not hold
whole.  Fragments form a monoid: their union, in which each complete sibling run is replaced by its parent, is associative
and commutative.  They are reduced as a tree of FAN neighbours a step, so that runs complete early and a fragment stays at
some 30 nodes a level; each step is a written table.  The nodes made on the way, met by the ranges at their ends, are all
that a range needs besides its own leaves to prove each of its documents.  No more than a summary row a range and the root
reach the driver.

Edge cases: a missing field is hashed as such; a null source is a source of its own, before all others; null ids come
first in their source; rows of equal id follow by their hashes, and equal rows are leaves each.  Texts of any length are
hashed whole in the JVM.  An empty table has no root and no rows.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import string
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import prepare, stored, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 16
#: Ranges that one step of the reduction merges.
FAN = 32
#: Leaves a range holds, or the root of their number.
RANGE_ROWS = 1 << 15
#: The tree whose leaves are the sources' roots.
TOP = -1
NODE = "part long, tree long, level int, idx long, size long, hash string, made boolean"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---- leaves --------------------------------------------------------------------------------------------------


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_hash(text: Column) -> Column:
    return F.sha2(F.concat(*(_field(F.col(c)) for c in FIELDS if c != "text"), _field(text)).cast("binary"), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, key (orders sources: null first, then by bytes), leaf, and the leaf of the tampered text, if there is one."""
    docs = docs.select(*FIELDS)
    other = F.lit(None).cast("string") if tampered is None else tampered
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("+"), "source")).alias("key"), leaf_hash(F.col("text").cast("string")).alias("leaf"), other.alias("other"))


def lowered_every_fifth() -> Column:
    """The tampering that a test applies: A-Z in lower case where 5 divides the id's crc32."""
    text = F.translate(F.col("text").cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf_hash(text))


# ---- the monoid of fragments ---------------------------------------------------------------------------------


def widths(size: int) -> list[int]:
    """Nodes a level of a tree of so many leaves."""
    out = [size]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


class Forest:
    """Nodes by (tree, level): {index: hash}; sizes of the trees.  all_nodes keeps what a completed run has consumed."""

    def __init__(self, sizes: dict[int, int]):
        self.sizes, self.open, self.made = sizes, defaultdict(dict), []
        self.all_nodes: dict[tuple[int, int], dict[int, str]] = defaultdict(dict)

    def put(self, tree: int, level: int, idx: int, value: str) -> None:
        self.open[tree, level][idx] = self.all_nodes[tree, level][idx] = value

    def resolve(self) -> Forest:
        """Replaces complete sibling runs by their parents, and a source's root by a leaf of the top tree."""
        for tree in sorted({t for t, _ in self.open if t != TOP}) + [TOP]:
            w = widths(self.sizes[tree]) if tree in self.sizes else []
            for level, n in enumerate(w):
                nodes = self.open.get((tree, level))
                if not nodes:
                    continue
                if n == 1:
                    if tree != TOP:
                        self._make(TOP, 0, tree, nodes.pop(0))
                    continue
                runs = defaultdict(list)
                for i in sorted(nodes):
                    runs[i // ARITY].append(i)
                for r, members in runs.items():
                    if len(members) == min(ARITY, n - ARITY * r):
                        self._make(tree, level + 1, r, digest("".join(nodes.pop(i) for i in members)))
        return self

    def _make(self, tree: int, level: int, idx: int, value: str) -> None:
        self.put(tree, level, idx, value)
        self.made.append((tree, level, idx))

    def rows(self, part: int, first: bool) -> pa.Table:
        """Open nodes for the next step (made, if they are new) and, but for a range's own, new ones already consumed."""
        made = set(self.made)
        out = [(part, t, lv, i, self.sizes[t], h, first or (t, lv, i) in made) for (t, lv), nodes in self.open.items() for i, h in nodes.items()]
        if not first:
            still = {(t, lv, i) for _, t, lv, i, *_ in out}
            out += [(-1, t, lv, i, self.sizes[t], self.all_nodes[t, lv][i], True) for t, lv, i in self.made if (t, lv, i) not in still]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        columns = list(zip(*out)) or [[]] * len(kinds)
        return pa.table({f.split()[0]: pa.array(c, k) for f, c, k in zip(NODE.split(", "), columns, kinds)})


def merged(rows: pa.Table) -> pa.Table:
    """The fragments of a group of neighbouring ranges as one."""
    t = rows.to_pydict()
    forest = Forest({})
    for tree, level, idx, size, value in zip(t["tree"], t["level"], t["idx"], t["size"], t["hash"]):
        forest.sizes[tree] = size
        forest.put(tree, level, idx, value)
    forest.sizes.setdefault(TOP, t["sources"][0])
    return forest.resolve().rows(t["group"][0], False)


# ---- ranges --------------------------------------------------------------------------------------------------

PLACE = "part long, held long, rank long, start long, first_rows long, first_size long, last_rows long, last_size long, sources long"


def places(ranged: DataFrame) -> list[tuple]:
    """PLACE rows: the sources a range holds, the rank of its first one, the index of its first leaf there, and the leaves
    of its first and last source in the range and in all; from a summary row a range."""
    by_source = ranged.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"))
    summary = by_source.groupBy("part").agg(F.count(F.lit(1)).alias("held"), F.min(F.struct("key", "n")).alias("first"), F.max(F.struct("key", "n")).alias("last")).orderBy("part").collect()
    out, size, rank, running, key = [], defaultdict(int), -1, 0, None
    for r in summary:
        if r.first.key != key:
            rank, running = rank + 1, 0
        ends = rank + r.held - 1
        out.append((r.part, r.held, rank, running, r.first.n, ends, r.last.n))
        size[rank] += r.first.n
        if r.held > 1:
            size[ends] += r.last.n
            running = 0
        rank, running, key = ends, running + r.last.n, r.last.key
    return [(p, held, at, start, n, size[at], last_n, size[ends], rank + 1) for p, held, at, start, n, ends, last_n in out]


@dataclass
class Segment:
    tree: int
    start: int
    end: int
    size: int


def segments(held: int, rank: int, start: int, first_rows: int, first_size: int, last_rows: int, last_size: int, sources: int) -> list[Segment]:
    """The parts of trees that a range holds only in part, or may: its first and last source and the top tree."""
    out = [Segment(rank, start, start + first_rows, first_size)]
    if held > 1:
        out.append(Segment(rank + held - 1, 0, last_rows, last_size))
    return [*out, Segment(TOP, rank, rank + held, sources)]


def _local(rows: pa.Table, place: dict) -> tuple[pa.Table, list[Segment], Forest]:
    """A range's leaves in order, the segments of its sources, and its resolved fragment."""
    by = [("key", "ascending"), ("doc_id", "ascending"), ("leaf", "ascending"), ("other", "ascending")]
    rows = rows.take(pc.sort_indices(rows, sort_keys=by, null_placement="at_start"))
    keys = rows["key"].combine_chunks().dictionary_encode().indices.to_numpy()
    bounds = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    own = []
    for k in range(len(bounds) - 1):
        n = bounds[k + 1] - bounds[k]
        start = place["start"] if k == 0 else 0
        size = place["first_size"] if k == 0 else place["last_size"] if k == len(bounds) - 2 else n
        own.append(Segment(place["rank"] + k, start, start + n, size))
    forest = Forest({s.tree: s.size for s in own} | {TOP: place["sources"]})
    leaf = rows["leaf"].to_pylist()
    for s, at in zip(own, bounds):
        for i in range(s.start, s.end):
            forest.put(s.tree, 0, i, leaf[at + i - s.start])
    return rows, own, forest.resolve()


def _fragment(rows: pa.Table, place: pa.Table) -> pa.Table:
    at = place.to_pylist()[0]
    return _local(rows, at)[2].rows(at["part"], True)


def _asked(batches):
    """The nodes in whose sibling runs a range's segments end: all that it can miss."""
    for b in batches:
        out = set()
        for p in b.to_pylist():
            part = p.pop("part")
            for s in segments(**p):
                for level, n in enumerate(widths(s.size)):
                    for edge in (s.start, s.end - 1):
                        run = edge // ARITY ** (level + 1) * ARITY
                        out |= {(part, s.tree, level, i) for i in range(run, min(run + ARITY, n))}
        parts, trees, levels, idx = zip(*sorted(out)) if out else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(trees, pa.int64()), pa.array(levels, pa.int32()), pa.array(idx, pa.int64())], ["part", "tree", "level", "idx"])


@dataclass
class Manifest:
    """root (None of no documents), the ranged leaves, PLACE rows, and every node that two ranges share."""

    root: str | None
    ranged: DataFrame
    place: DataFrame
    nodes: DataFrame


def manifest(rows: DataFrame) -> Manifest:
    """The trees over leaves(): rows are stored, dealt to ranges, and their fragments reduced."""
    spark = prepare(rows.sparkSession)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    count = rows.count()
    ranges = count // max(RANGE_ROWS, math.isqrt(count)) + 1
    # row lets equal rows go to several ranges; they are told apart by nothing else, so its values do not matter
    ranged = rows.repartitionByRange(ranges, "key", "doc_id", "leaf", "other", "row").drop("row")
    ranged = stored(ranged.withColumn("part", F.spark_partition_id().cast("long")), "ranged")
    at = places(ranged)
    place = spark.createDataFrame(at, PLACE)
    step = ranged.groupBy("part").cogroup(place.groupBy("part")).applyInArrow(_fragment, NODE)
    tables, left = [stored(step, "fragments")], max((p[0] for p in at), default=0) + 1
    sources = at[-1][-1] if at else 0
    while at:
        step = tables[-1].where("part >= 0").withColumns({"sources": F.lit(sources), "group": F.floor(F.col("part") / FAN)})
        step = step.groupBy("group").applyInArrow(merged, NODE)
        tables.append(stored(step, "fragments"))
        left = -(-left // FAN)
        if left == 1:
            break
    nodes = reduce(DataFrame.union, tables).where("made").select("tree", "level", "idx", "hash")
    top = nodes.where((F.col("tree") == TOP) & (F.col("level") == len(widths(sources)) - 1)).first() if at else None
    return Manifest(top and top.hash, ranged, place, nodes)


# ---- proofs --------------------------------------------------------------------------------------------------


class Paths:
    """Sibling hashes before and after each node on the way from a node to the root."""

    def __init__(self, forest: Forest):
        self.forest, self.widths, self.last = forest, {}, {}

    def to_root(self, tree: int, level: int, idx: int) -> list[tuple[str, str]]:
        if tree not in self.widths:
            self.widths[tree] = widths(self.forest.sizes[tree])
        w = self.widths[tree]
        if w[level] == 1:
            return [] if tree == TOP else self.to_root(TOP, 0, tree)
        run = idx // ARITY
        key, above = self.last.get((tree, level), (None, None))
        if key != run:  # leaves come in order, so the last run of a level is enough to keep
            above = self.to_root(tree, level + 1, run)
            self.last[tree, level] = run, above
        nodes = self.forest.all_nodes[tree, level]
        first = run * ARITY
        end = min(first + ARITY, w[level])
        return [("".join(nodes[i] for i in range(first, idx)), "".join(nodes[i] for i in range(idx + 1, end))), *above]


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    return reduce(lambda h, s: digest(s[0] + h + s[1]), path, leaf)


def proofs(m: Manifest) -> DataFrame:
    """doc_id, leaf, other, subroot, root, proof (siblings in order, joined, as their hash), folded_root, verified."""
    out = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if m.root is None:
        return m.ranged.sparkSession.createDataFrame([], out)
    root = m.root

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        known = known.to_pylist()
        rows, own, forest = _local(rows, known[0])
        for k in known:
            if k["tree"] is not None:
                forest.all_nodes[k["tree"], k["level"]][k["idx"]] = k["hash"]
        paths, columns = Paths(forest), ([], [], [])
        leaf, other = rows["leaf"].to_pylist(), rows["other"].to_pylist()
        at = 0
        for s in own:
            subroot = forest.all_nodes[TOP, 0][s.tree]
            for i in range(s.start, s.end):
                path = paths.to_root(s.tree, 0, i)
                columns[0].append(subroot)
                columns[1].append(digest("".join(a + b for a, b in path)))
                columns[2].append(folded(other[at] or leaf[at], path))
                at += 1
        sub, proof, fold = (pa.array(c, pa.string()) for c in columns)
        return pa.table({"doc_id": rows["doc_id"], "leaf": rows["leaf"], "subroot": sub, "root": pa.array([root] * at, pa.string()), "proof_sha256": proof, "folded_root": fold, "verified": pc.equal(fold, root)})

    asked = m.place.mapInArrow(_asked, "part long, tree long, level int, idx long")
    known = m.place.join(asked.join(m.nodes, ["tree", "level", "idx"]), "part", "left")
    return m.ranged.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(run, out)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs(manifest(leaves(table(spark, sf_dir, "documents"), lowered_every_fifth())))


def _sql(levels: int = 6) -> str:
    """Levels of up to 16 ** levels leaves a tree, unrolled."""
    field = lambda e: f"case when {e} is null then '-' else concat(octet_length(encode(cast({e} as varchar))), ':', cast({e} as varchar)) end"
    leaf = lambda text: f"sha256(concat({', '.join(field(c) for c in FIELDS if c != 'text')}, {field(text)}))"
    low = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    # crc32 by its definition: bits of the remainder, most significant first in reversed bytes
    bits = "list_reduce(list_concat([4294967295], list_transform(range(1, length(d) + 1), lambda i: ascii(d[i]))), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda v, _: case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end))"
    crc = f"(select xor({bits}, 4294967295) from (select cast(doc_id as varchar) as d) z)"
    out = [f"l as materialized (select doc_id, source, {leaf('text')} as leaf, case when {crc} % 5 = 0 then {leaf(low)} end as other from documents)"]
    out.append("b as materialized (select *, row_number() over (partition by source order by doc_id nulls first, leaf, other) - 1 as i, count(*) over (partition by source) as n, dense_rank() over (order by source nulls first) - 1 as s from l)")

    def tree(name: str, start: str) -> None:
        """name0.. have (t, i, n, h); a level ends a tree when n = 1."""
        out.append(f"{name}0 as materialized ({start})")
        for k in range(levels):
            out.append(f"{name}{k + 1} as materialized (select t, i // {ARITY} as i, (any_value(n) + {ARITY - 1}) // {ARITY} as n, sha256(string_agg(h, '' order by i)) as h from {name}{k} where n > 1 group by t, i // {ARITY})")

    tree("s", "select s as t, i, n, leaf as h from b")
    roots = " union all ".join(f"select t, h from s{k} where n = 1" for k in range(levels + 1))
    tree("r", f"select 0 as t, t as i, count(*) over () as n, h from ({roots}) q")
    roots = " union all ".join(f"select h from r{k} where n = 1" for k in range(levels + 1))
    out.append(f"root as (select h as root from ({roots}) q)")
    out.append("p0 as (select doc_id, leaf, coalesce(other, leaf) as f, s as t, i, s, '' as proof, row_number() over () as u from b)")
    steps = [("s", k) for k in range(levels)] + [("r", k) for k in range(levels)]
    for k, (name, level) in enumerate(steps):
        if (name, level) == ("r", 0):
            out.append(f"q{k} as (select * replace (0 as t, s as i) from p{k})")
        before = f"q{k}" if (name, level) == ("r", 0) else f"p{k}"
        out.append(f"""p{k + 1} as materialized (select p.doc_id, p.leaf, p.t, p.i // {ARITY} as i, p.s, p.u,
  case when count(x.h) = 0 then any_value(p.f) else sha256(string_agg(case when x.i = p.i then p.f else x.h end, '' order by x.i)) end as f,
  concat(any_value(p.proof), coalesce(string_agg(x.h, '' order by x.i) filter (where x.i <> p.i), '')) as proof
  from {before} p left join {name}{level} x on x.t = p.t and x.n > 1 and x.i // {ARITY} = p.i // {ARITY} group by p.doc_id, p.leaf, p.t, p.i, p.s, p.u)""")
    return f"""with {', '.join(out)}
select doc_id, leaf, x.h as subroot, root, sha256(proof) as proof_sha256, f as folded_root, f = root as verified from p{len(steps)} p join r0 x on x.i = p.s, root"""


SQL = _sql()
