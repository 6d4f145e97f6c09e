"""Near-equal lines by a deletion-neighbourhood join, with DataFrame functions only.

Two lines are near-equal if one character is inserted, deleted or replaced (edit distance at most 1), which they are
if and only if they share a variant: the line itself or the line without one character.  Distinct lines come
first.  Most have no partner, which is seen without variants: near-equal lines of lengths c and c or c + 1 agree in
their first or last (c - 1) / 2 characters.  Lines of which some half is shared are cut into 8 segments (64 beyond
LONG characters) and keyed by all but one segment; where such a key is shared, an edit can lie in that segment, and
all variants that lose one of its characters are emitted as hashed keys: together these are all variants within the
bound that another line can share.

Equal variants meet by aggregation, not in pairs.  Lines that lose the same position for the same variant are near-equal
to one another; lines that shorten to a variant which is itself a line are near-equal to that line.  So minima of
groups give each line its earliest near-equal line, whose edit distance is then verified.  A group of any size costs
one aggregated row a task and key.

A line goes if an equal or near-equal line comes earlier, by (doc_id, text's hash, place); the earliest is kept.
Whether that earlier line goes too does not matter.

Edge cases: lines are the parts between \\n; those without a word are kept and not compared; a null text has no lines;
null ids come last; rows of equal doc_id and text are one document and get equal results; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import prepare, stored, table

NO_ID, LONG = (1 << 63) - 1, 4096


def _documents(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, line, h1, h2) of every line with a word."""
    d = _documents(docs).select("doc_id", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return d.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), "line")})


def distinct_lines(lines: DataFrame) -> DataFrame:
    """(h1, h2, place, n, line): every different line once, by its 128-bit hash.

    The filter holds always; it keeps place and n in every use of the aggregate with lines, so that one exchange of
    the lines serves all of them.
    """
    d = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "th", "pos")).alias("place"), F.count(F.lit(1)).alias("n"), F.first("line").alias("line"))
    return d.where("n > 0 and place is not null")


def _classes(lines: DataFrame) -> DataFrame:
    """Each line twice, under the length of the shorter of a pair: its own (long false), and one less (long true)."""
    size = F.char_length("line")
    two = F.array(F.struct(size.alias("c"), F.lit(False).alias("long")), F.struct((size - 1).alias("c"), F.lit(True).alias("long")))
    return lines.withColumn("size", size).withColumn("x", F.explode(two)).select("*", "x.c", "x.long").drop("x").where("c > 0")


def _shared(keyed: DataFrame, key: str) -> DataFrame:
    """Keys that two lines have, one of them with the key's own length."""
    return keyed.groupBy(key).agg(F.count(F.lit(1)).alias("k"), F.bool_or(~F.col("long")).alias("own")).where("k > 1 and own").select(key)


def paired(lines: DataFrame) -> DataFrame:
    """The lines of which some half is shared by another."""
    half = "cast((c - 1) div 2 as int)"
    keys = F.expr(f"array(xxhash64(0, c, left(line, {half})), xxhash64(1, c, right(line, {half})))")
    halves = _classes(lines.select("h1", "h2", "line")).select("h1", "h2", "long", F.explode(keys).alias("half"))
    found = halves.join(_shared(halves, "half"), "half").select("h1", "h2").distinct()
    return lines.join(found, ["h1", "h2"])


def variants(lines: DataFrame) -> DataFrame:
    """(key, role, h1, at): role 0 lost a position that it shares with its group, 1 lost any, 2 is the variant itself."""
    seg = _classes(lines).withColumn("q", F.when(F.col("c") > LONG, 64).otherwise(8)).withColumn("j", F.explode(F.expr("sequence(0, q - 1)")))
    seg = seg.withColumn("lo", F.expr("cast(j * cast(c as long) div q as int)")).withColumn("hi", F.expr("cast((j + 1) * cast(c as long) div q as int)"))
    seg = seg.withColumn("seg", F.expr("xxhash64(c, j, left(line, lo), right(line, c - hi))"))
    seg = seg.join(_shared(seg, "seg"), "seg")
    seg = seg.select("seg", "long", "h1", F.struct("place", "h1").alias("at"), F.expr("substring(line, lo + 1, size - lo - (c - hi))").alias("mid"))
    cut = seg.withColumn("m", F.char_length("mid")).where("m > 0").withColumn("i", F.explode(F.expr("sequence(0, m - 1)")))
    rest = "left(mid, i), right(mid, m - 1 - i)"
    lost = cut.select(F.when(F.col("long"), F.expr(f"xxhash64(1, seg, concat({rest}))")).otherwise(F.expr(f"xxhash64(0, seg, i, {rest})")).alias("key"), F.col("long").cast("int").alias("role"), "h1", "at")
    return lost.unionByName(seg.where("not long").select(F.expr("xxhash64(1, seg, mid)").alias("key"), F.lit(2).alias("role"), "h1", "at"))


def earliest(lines: DataFrame) -> DataFrame:
    """(h1, h2, place, line, other): the earliest near-equal line of each paired line that has one, verified."""
    rows = variants(lines)
    least = lambda role: F.min(F.when(F.col("role") == role, F.col("at")))
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("k"), *(least(r).alias(f"r{r}") for r in range(3))).where("k > 1").drop("k")
    other = F.when(F.col("role") == 0, F.col("r0")).when(F.col("role") == 1, F.col("r2")).otherwise(F.col("r1"))
    best = rows.join(groups, "key").select("h1", other.alias("other")).where("other.h1 <> h1").groupBy("h1").agg(F.min("other").alias("other"))
    own = lines.select("h1", "h2", "place", "line")
    theirs = lines.select(F.col("h1").alias("oh"), F.col("line").alias("other_line"))
    met = own.join(best, "h1").withColumn("oh", F.col("other.h1")).join(theirs, "oh")
    return met.where(F.levenshtein("line", "other_line", 1) >= 0).select("h1", "h2", "place", "line", F.col("other.place").alias("other"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_near, kept (the text without the lines that go)."""
    prepare(docs.sparkSession)
    lines = lines_of(docs)
    different = distinct_lines(lines)
    near = earliest(stored(paired(different).select("h1", "h2", "place", "line"), "paired")).where(F.col("other") < F.col("place")).select("h1", "h2", F.lit(True).alias("near"))
    copied = different.join(near, ["h1", "h2"], "left").where("n > 1 or near").select("h1", "h2", "place", F.coalesce("near", F.lit(False)).alias("near"))
    met = lines.select("doc_id", "th", "pos", "h1", "h2").join(copied, ["h1", "h2"]).withColumn("first", F.struct("doc_id", "th", "pos") == F.col("place"))
    gone = met.where("near or not first").groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone"), F.size(F.collect_set(F.when(F.col("first"), F.col("pos")))).alias("n_near"))
    d = _documents(docs).join(gone, ["doc_id", "th"], "left").withColumn("parts", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    left = F.expr("array_except(sequence(0, size(parts) - 1), coalesce(gone, array()))")
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.get("parts", i)), "\n"))
    count = F.size(F.filter("parts", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    removed = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    return d.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), count.alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(removed).cast("long").alias("n_removed"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), kept.alias("kept"))


def op3_line_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


SQL = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as p from documents),
l as (select doc_id, unnest(generate_series(1, len(p))) as pos, unnest(p) as line from d),
w as (select * from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
u as (select line, min(struct_pack(doc_id := doc_id, pos := pos)) as place, length(line) as n from w group by line),
x as (select *, unnest([n, n - 1]) as c from u),
k as (select *, unnest(['p' || left(line, greatest(0, cast(floor((c - 1) / 2.0) as int))), 's' || case when c < 3 then '' else right(line, cast(floor((c - 1) / 2.0) as int)) end]) as h from x where c > 0),
near as (select distinct a.line from k a join k b on a.c = b.c and a.h = b.h and a.line <> b.line and b.place < a.place and least(a.n, b.n) = a.c
  where len(list_filter(generate_series(0, greatest(a.n, b.n) - 1), lambda e: left(a.line, e) = left(b.line, e)
    and substr(a.line, e + case when a.n >= b.n then 2 else 1 end) = substr(b.line, e + case when b.n >= a.n then 2 else 1 end))) > 0),
g as (select w.doc_id, w.pos, near.line is not null and struct_pack(doc_id := w.doc_id, pos := w.pos) = u.place as near
  from w join u using (line) left join near using (line) where near.line is not null or struct_pack(doc_id := w.doc_id, pos := w.pos) <> u.place),
t as (select l.doc_id, string_agg(l.line, chr(10) order by l.pos) as kept from l left join g on g.doc_id = l.doc_id and g.pos = l.pos where g.pos is null group by l.doc_id)
select d.doc_id, cast((select count(*) from w where w.doc_id = d.doc_id) as bigint) as n_lines, cast((select count(*) from g where g.doc_id = d.doc_id) as bigint) as n_removed,
  cast((select count(*) from g where g.doc_id = d.doc_id and g.near) as bigint) as n_near, sha256(coalesce(t.kept, '')) as kept_sha256
from d left join t using (doc_id)
"""
