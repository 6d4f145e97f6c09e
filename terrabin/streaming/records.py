"""Counts kept up to date from streams.

A batch of a stream is aggregated to its keys and written under its number; the counts are the sum over batches.  A batch
that is repeated after a failure replaces what it wrote before, so every row counts once; sums do not depend on the order
in which rows come, so late rows count like others and no state is kept in the stream.  Batches are folded into one from
time to time; a marker, written last, says which.  windowed_counts is for readers that want event-time windows instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrabin.shipping import spread


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, event_type, n) of events with ts, in event time; state is bounded by the watermark."""
    ts = F.col("ts").cast("timestamp")
    return events.withColumn("ts", ts).withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"))


class Counts:
    """Sums by keys below a path; aggregate turns a batch's rows to keys and columns that add up."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], sums: list[str], aggregate: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.keys, self.sums, self.aggregate = spark, path, keys, sums, aggregate

    def merge(self, rows: DataFrame, batch: int) -> None:
        """A batch's sums, in place of those that it may have written before."""
        self.aggregate(rows).select(*self.keys, *self.sums).write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch}")

    def run(self, stream: DataFrame) -> None:
        """Reads all that is there to read, from the last checkpoint on."""
        out = stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True)
        out.start().awaitTermination()

    def folded(self) -> int:
        """The last batch that is part of the folded sums, or -1."""
        try:
            return self.spark.read.schema("upto bigint").parquet(f"{self.path}/markers").agg(F.max("upto")).first()[0]
        except Exception as e:  # nothing has been folded yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return -1

    def _parts(self) -> tuple[DataFrame, int]:
        upto = self.folded()
        rows = self.spark.read.parquet(f"{self.path}/batches").where(F.col("batch") > upto)
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.drop("batch")
        if upto >= 0:
            rows = rows.unionByName(self.spark.read.parquet(f"{self.path}/folded/upto={upto}"))
        return rows, upto if last is None else last

    def current(self) -> DataFrame:
        rows, _ = self._parts()
        return spread(rows, rows.count(), *self.keys).groupBy(*self.keys).agg(*(F.sum(c).alias(c) for c in self.sums))

    def fold(self) -> int:
        """Sums all batches so far into one folder; readers go on with the old ones until the marker is there."""
        _, last = self._parts()
        self.current().write.mode("overwrite").parquet(f"{self.path}/folded/upto={last}")
        self.spark.createDataFrame([(last,)], "upto bigint").write.mode("append").parquet(f"{self.path}/markers")
        return last
