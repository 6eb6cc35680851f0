"""Intermediate results on shared storage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

PREFIX = "marketframe-"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    Only a session whose executors are threads of the driver may go without one; it
    gets a temporary folder. Elsewhere each executor would write to its own disk, so
    a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_table(spark: SparkSession) -> str:
    """Path of a new table in the shared folder."""
    return f"{shared_folder(spark)}/{PREFIX}{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write a result as a table in the shared folder and read it back.

    Cuts the lineage like a checkpoint, computes the plan once, keeps the columns
    prunable, and survives the loss of executors.
    """
    path = new_table(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on any file system that Spark reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Seconds between two calls of the driver's garbage collector, and when the last one was.
PAUSE = 3.0
_collected = [0.0]


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over.

    It does so once the driver's objects that name them are collected, which by itself
    happens when the heap is full or every half hour: too late for a chain of jobs
    whose files fill the executors' disks.
    """
    if time.monotonic() - _collected[0] > PAUSE:
        gc.collect()
        spark._jvm.System.gc()
        _collected[0] = time.monotonic()


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and that nothing reads any more, and the
    shuffle files of the jobs before."""
    if tables:
        release(tables[0].sparkSession)
    for df in tables:
        spark, folders = df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            if folder.rsplit("/", 1)[-1].startswith(PREFIX):
                delete(spark, folder)
