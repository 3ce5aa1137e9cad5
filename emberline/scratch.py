"""Intermediate tables in the folder that all executors share.

Iterative plans are cut by writing a table and reading it again, so that a lost
executor never takes the only copy with it.  The folder is ``spark.checkpoint.dir``
of the session; where that is unset and all runs in one machine (unit tests) a local
default is used, and on a cluster that is an error.  What an application leaves there is
deleted when its driver ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_DIR = "/tmp/checkpoints"


_cleared: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """URI of this application's own folder below the shared one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if not base and not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir is not set: executors of a cluster need a folder that all of them share")
    path = f"{(base or DEFAULT_DIR).rstrip('/')}/emberline/{spark.sparkContext.applicationId}"
    if path not in _cleared:
        _cleared.add(path)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        where.mkdirs(folder)
        where.deleteOnExit(folder)
    return path


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, label: str = "t") -> DataFrame:
    """Write df as Parquet to the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once its results are written."""
    delete(spark, shared_dir(spark))
