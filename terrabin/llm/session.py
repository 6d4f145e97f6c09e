"""Session helpers for the corpus operators: shipped code, the shared folder, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrabin.shipping import shared_dir, ship, stored  # noqa: F401

#: Rows an Arrow batch may hold; texts can be long, and a batch is held whole in a Python worker.
ARROW_ROWS = "1000"


def prepare(spark: SparkSession) -> SparkSession:
    """Ships this package to the executors once a session and bounds Arrow batches."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a whole text column."""
    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
