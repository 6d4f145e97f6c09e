"""Sends this package to the executors once a session, so that Python workers can import it anywhere; the shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    sc = spark.sparkContext
    if not getattr(sc, "_terrabin_shipped", False):
        root = Path(__file__).resolve().parents[1]
        folder = Path(tempfile.mkdtemp(prefix="terrabin-"))
        with zipfile.ZipFile(folder / "terrabin.zip", "w") as z:
            for p in sorted((root / "terrabin").rglob("*.py")):
                z.write(p, p.relative_to(root))
        sc.addPyFile(str(folder / "terrabin.zip"))
        sc._terrabin_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.  Where it is unset, a local master gets one of
    its own; on a cluster that is an error, as each executor would write to its own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = getattr(spark.sparkContext, "_terrabin_dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.sparkContext._terrabin_dir = Path(tempfile.mkdtemp(prefix="terrabin-shared-")).as_uri()
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Rows of a task on average, from which on the session's number of partitions no longer decides.
TASK_ROWS = 500_000


def tasks(spark: SparkSession, rows: int, task_rows: int | None = None) -> int:
    """How many tasks of some TASK_ROWS so many rows make, the session's partitions at least; 0 where every core's share of
    the rows is smaller anyway."""
    n = -(-rows // (task_rows or TASK_ROWS))
    return max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))) if n > spark.sparkContext.defaultParallelism else 0


def dealt(df: DataFrame, rows: int, *keys) -> DataFrame:
    """df by keys in as many tasks as tasks() says; unlike spread, also where the session has many partitions but the tasks
    that read df would sum more rows each."""
    n = tasks(df.sparkSession, rows)
    return df.repartition(n, *keys) if n else df


def spread(df: DataFrame, rows: int, *keys, task_rows: int | None = None) -> DataFrame:
    """df by keys in tasks of some TASK_ROWS of so many rows, where the session's partitions would be larger: a task's memory
    then does not grow with the table."""
    n = -(-rows // (task_rows or TASK_ROWS))
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
