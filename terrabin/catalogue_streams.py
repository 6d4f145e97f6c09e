"""Queries that run a stream to its end: the table is dealt to files, read in batches, stopped, and gone on with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrabin.catalogue import _b, query
from terrabin.operators import strata
from terrabin.shipping import TASK_ROWS, shared_dir
from terrabin.streaming.records import Counts

FILES, FIRST = 6, 4
#: Files that a batch has at most, so that its size does not grow with the table.
BATCH = 8


def _streamed(rows: DataFrame, order: str, counts: Counts, folder: str) -> DataFrame:
    """Deals rows to files so that each holds rows of all times, streams the first files, and the late ones after a restart.
    There are two files each time, or as many as have some TASK_ROWS / 2 rows; a batch has half of them or BATCH."""
    spark, file = rows.sparkSession, F.pmod(F.col(order), F.lit(FILES))
    files = max(2, -(-rows.count() // TASK_ROWS))
    dealt = F.pmod(F.col(order), F.lit(2)) if files == 2 else F.xxhash64(*rows.columns)
    at = lambda part: rows.where(part).repartition(files, dealt).write.mode("append").parquet(folder)
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", min(BATCH, files // 2)).parquet(folder)
    at(file < FIRST)
    counts.run(stream())
    counts.fold()
    at(file >= FIRST)
    counts.run(stream())
    return counts.current()


@query("A1_streamed_counts", "select user_id, event_type, cast(date_trunc('day', ts) as date) as day, cast(count(*) as bigint) as n, cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents from events group by 1, 2, 3", "events")
def _(events):
    """Records by user, kind and day, of which each file brings some for every day."""
    path = shared_dir(events.sparkSession)
    total = [F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents")]
    counts = Counts(events.sparkSession, f"{path}/counts", ["user_id", "event_type", "day"], ["n", "cents"], lambda rows: rows.groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(*total))
    return _streamed(events.select("event_id", "user_id", "event_type", "ts", "value"), "event_id", counts, f"{path}/in")


@query("A6_streamed_strata", "select gx, gy, pref, region, k, alt, cast(sum(n) as bigint) as n from cell group by gx, gy, pref, region, k, alt", "px", "cell")
def _(px, cell):
    """Strata of cells whose pixels come in several batches."""
    path = shared_dir(px.sparkSession)
    counts = Counts(px.sparkSession, f"{path}/counts", ["gx", "gy", "pref", "region", "k", "alt"], ["n"], strata.cells_of_pixels)  # repeats add up
    out = _streamed(px, "x", counts, f"{path}/in")
    return out.select("gx", "gy", "pref", "region", "k", "alt", _b("n"))
