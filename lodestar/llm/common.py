"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS, ROW_GROUP = 100_000, 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows take long to work on: a small one in fewer files than there are cores is dealt over them, as a file may be
    one row group, which one task reads whatever its splits."""
    rows, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * ROW_GROUP and len(rows.inputFiles()) < cores else rows


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a session on this machine alone (a test) gets one of its own."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestar-checkpoint-"))
    return named or context.getCheckpointDir()


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read from there: nothing of its plan, and so of its shuffles, is kept."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def let_go(spark: SparkSession) -> None:
    """Delete the shuffle files of tables that nothing refers to any more, which Spark does when the driver's garbage is collected: first
    that of Python, then that of the JVM, and again for what only the first round let go."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(1)


def partitions_for(rows: int, rows_each: int, at_least: int) -> int:
    """Partitions that hold about ``rows_each`` rows, never fewer than ``at_least``."""
    return max(at_least, -(-rows // rows_each))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    while name in df.columns:
        name = "_" + name
    return name


def small_side(df: DataFrame) -> DataFrame:
    """``df``, worked out, and marked for broadcast if it has at most ``BROADCAST_ROWS`` rows of a few numbers each."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
