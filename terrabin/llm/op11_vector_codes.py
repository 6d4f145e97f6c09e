"""Product codes of vectors: eight integer codebooks of sixteen entries, learned by rounds over all vectors.

The codebooks (8 x 16 entries, bounded by the vectors' width) go to every task; Arrow batches find each part's nearest
entry by |x|^2 - 2 x.c + |c|^2 in exact int64 matrix products, the first of equal ones.  A round's sums are combined in
the task, flushed as (part, entry, position) rows and merged by one grouped shuffle of at most 16 rows a component and
task; the driver gets the merged 16 rows a component.  Vectors are never shuffled, and a lost task only repeats its share.

Edge cases: a vector that is null or holds null, NaN or infinite components is dropped.  Vectors are padded with zeros
to the longest kept one, and to a multiple of eight; an empty vector is all zeros.  Fewer than 16 vectors give fewer
entries.  A null vec_id sorts last; equal vec_ids are ordered by their vectors.  Repeated rows are kept and count each.
Components saturate at 2**40 and errors at 2**63 - 1; batches too large for int64 use Python integers.  An empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import prepare, stored, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LIMIT, MOST = 2**40, 2**63 - 1
#: Vectors whose sums a task holds before it passes them on: sums of 2**20 components of 2**40 fit into 64 bits.
FLUSH_ROWS = 1 << 20
#: A label with more than this share of the rows meets its total by broadcast; so there are at most as many as its inverse.
HOT_SHARE = 1 / 1000


def _vectors(rows: DataFrame, column: str) -> DataFrame:
    """vec_id, label and the vector as floats."""
    kind = rows.schema[column].dataType
    narrow = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    label = F.col("label") if "label" in rows.columns else F.lit(None).cast("int")
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col(column).cast("array<float>" if narrow else "array<double>").alias("vector"))


def _sound(vector: str):
    """Neither null nor with null, NaN or infinite components (Spark orders NaN above infinity)."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))


def integers(x: np.ndarray) -> np.ndarray:
    """floor(4096 x) as int64, saturated."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x.astype(np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int64)


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of an Arrow list column are sound, and those as integers, padded to width."""
    lengths = np.diff(column.offsets.to_numpy())
    lengths[column.is_null().to_numpy(zero_copy_only=False)] = 0
    flat = column.flatten().to_numpy(zero_copy_only=False)  # a null component reads as NaN
    row = np.repeat(np.arange(len(column)), lengths)
    sound = ~column.is_null().to_numpy(zero_copy_only=False)
    sound[row[~np.isfinite(flat)]] = False
    out = np.zeros((len(column), width), np.int64)
    starts = np.cumsum(lengths) - lengths
    good = np.isfinite(flat) & sound[row]
    out[row[good], (np.arange(len(flat)) - starts[row])[good]] = integers(flat[good])
    return sound, out[sound]


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, 8) and squared distances (n, 8) of vectors (n, width) by books (8, entries, width / 8)."""
    n, width = x.shape
    top = max((int(np.abs(a).max()) for a in (x, books) if a.size), default=0)
    kind = np.int64 if width * (2 * top) ** 2 < 2**62 else object
    x, books = x.astype(kind).reshape(n, PARTS, width // PARTS), books.astype(kind)
    codes, errors = np.zeros((n, PARTS), np.uint8), np.zeros((n, PARTS), kind)
    for j in range(PARTS):
        part, book = x[:, j], books[j]
        d = (part * part).sum(axis=1, keepdims=True) - 2 * (part @ book.T) + (book * book).sum(axis=1)
        codes[:, j] = d.argmin(axis=1)
        errors[:, j] = d[np.arange(n), codes[:, j]]
    return codes, errors


def summed(x: np.ndarray, codes: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums (8, entries, width / 8) and counts (8, entries) of the parts by their codes."""
    x = x.reshape(len(x), PARTS, x.shape[1] // PARTS)
    sums, counts = np.zeros((PARTS, entries, x.shape[2]), np.int64), np.zeros((PARTS, entries), np.int64)
    for j in range(PARTS):
        order = np.argsort(codes[:, j], kind="stable")
        used, first = np.unique(codes[order, j], return_index=True)
        sums[j, used] = np.add.reduceat(x[order, j], first, axis=0) if x.shape[2] else 0
        counts[j] = np.bincount(codes[:, j], minlength=entries)
    return sums, counts


def first_books(vectors: DataFrame, width: int) -> np.ndarray:
    """The parts of the 16 smallest kept vec_ids."""
    rows = vectors.where(_sound("vector")).orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).select("vector").collect()
    x = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        x[i, : len(r.vector)] = integers(np.array(r.vector, np.float64))
    return np.ascontiguousarray(x.reshape(len(rows), PARTS, width // PARTS).transpose(1, 0, 2))


def refined(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every part assigned, and each used entry replaced by the floor of its parts' mean."""
    entries, width = books.shape[1], books.shape[2] * PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, held = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64), 0

        def flushed() -> pa.RecordBatch:
            j, e, at = (a.reshape(-1) for a in np.indices(books.shape))
            used = counts[j, e] > 0
            return pa.RecordBatch.from_arrays([pa.array(a[used]) for a in (j.astype(np.int32), e.astype(np.int32), at.astype(np.int32), sums.reshape(-1), counts[j, e])], ["part", "entry", "position", "total", "n"])

        for b in batches:
            _, x = matrix(b.column(0), width)
            for k in range(0, len(x), FLUSH_ROWS):
                slab = x[k : k + FLUSH_ROWS]
                if held + len(slab) > FLUSH_ROWS:
                    yield flushed()
                    sums[:], counts[:], held = 0, 0, 0
                more, n = summed(slab, nearest(slab, books)[0], entries)
                sums += more
                counts += n
                held += len(slab)
        if held:
            yield flushed()

    partial = vectors.select("vector").mapInArrow(run, "part int, entry int, position int, total long, n long")
    merged = partial.groupBy("part", "entry", "position").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n")).collect()
    out = books.copy()
    for r in merged:
        out[r.part, r.entry, r.position] = int(r.total) // r.n
    return out


def learn(vectors: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (8, entries, width / 8) of all vectors: the only state between rounds."""
    longest = vectors.where(_sound("vector")).agg(F.max(F.size("vector"))).first()[0] or 0
    books = first_books(vectors, -(-longest // PARTS) * PARTS)
    for _ in range(rounds if books.shape[1] else 0):
        books = refined(vectors, books)
    return books


def encoded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of every sound vector."""
    label = vectors.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sound, x = matrix(b.column(2), books.shape[2] * PARTS)
            if not len(x):
                continue
            codes, errors = nearest(x, books)
            kept = pa.array(sound)
            error = [min(int(e), MOST) for e in errors.sum(axis=1)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(kept), b.column(1).filter(kept), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return vectors.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def with_label_error(rows: DataFrame) -> DataFrame:
    """rows with label_error, the sum of error over equal labels, nulls together.

    Totals are combined in each task first.  Labels with more than a thousandth of the rows (at most a thousand) meet
    them by broadcast; the others by a join on the label, in which rows of the former spread by vec_id."""
    key = F.struct(F.col("label").isNull().alias("none"), F.col("label").alias("label"))
    rows = rows.withColumn("_label", F.to_json(key))
    totals = rows.groupBy("_label").agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(MOST).cast("decimal(20,0)")).cast("long").alias("total"), F.count(F.lit(1)).alias("n"))
    totals = stored(totals, "label_totals")
    least = (totals.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE
    hot, cold = totals.where(F.col("n") > least), totals.where(F.col("n") <= least)
    rows = rows.join(F.broadcast(hot.select("_label", F.col("total").alias("_hot"))), "_label", "left")
    rows = rows.withColumn("_label", F.when(F.col("_hot").isNull(), F.col("_label")).otherwise(F.xxhash64("vec_id").cast("string")))
    rows = rows.join(cold.select("_label", F.col("total").alias("_cold")), "_label", "left")
    return rows.withColumn("label_error", F.coalesce("_hot", "_cold")).drop("_label", "_hot", "_cold")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(rows: DataFrame, column: str = "embedding", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every sound vector, stored, and the codebooks that decode it."""
    prepare(rows.sparkSession)
    vectors = _vectors(rows, column)
    books = learn(vectors, rounds)
    return stored(encoded(vectors, books), "codes"), books


def decoded(code: str, books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for, in units of 1 / 4096."""
    return np.concatenate([books[j, c] for j, c in enumerate(bytes.fromhex(code))])


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compress(table(spark, sf_dir, "embeddings"))
    return with_label_error(rows).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} as materialized (select r, j, min([list_sum(list_transform(list_zip(w, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e]) as m from p join c{k} using (j) group by r, j)""")
        if k < ROUNDS:
            steps.append(f"""u{k} as (select j, m[2] as e, s, cast(floor(cast(sum(w[s]) as double) / count(*)) as bigint) as x from a{k} join p using (r, j), range(1, (select max(len(w)) from p) + 1) as t(s) group by 1, 2, 3),
c{k + 1} as materialized (select j, e, coalesce(n.c, o.c) as c from c{k} o left join (select j, e, list(x order by s) as c from u{k} group by 1, 2) n using (j, e))""")
    return f"""with v as materialized (select row_number() over (order by vec_id nulls last, embedding) as r, vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as q
  from embeddings where embedding is not null and coalesce(list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))), true)),
p as materialized (select r, j, q[j * len(q) // {PARTS} + 1 : (j + 1) * len(q) // {PARTS}] as w from v, range({PARTS}) as t(j)),
c0 as materialized (select j, r - 1 as e, w as c from p where r <= {ENTRIES}),
{', '.join(steps)},
s as (select sha256(string_agg(array_to_string(c, ','), ',' order by j, e)) as h from c{ROUNDS}),
o as (select r, string_agg(printf('%02x', m[2]), '' order by j) as code, cast(sum(m[1]) as bigint) as error from a{ROUNDS} group by r)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, h as codebooks_sha256 from v join o using (r), s"""


SQL = _sql()
