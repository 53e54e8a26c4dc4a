"""Intermediate tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir. Where that is unset, local mode gets a folder of its own; a cluster, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-tallyspan-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Folders of stored tables that nothing has released yet.
_held: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, computed once: written as Parquet to the shared folder and read from there, until `release`."""
    path = shared_folder(df.sparkSession)
    _held.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete all tables stored so far, for callers that are done with the frames made from them; returns how many."""
    context, n = spark.sparkContext, len(_held)
    while _held:
        path = context._jvm.org.apache.hadoop.fs.Path(_held.pop())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return n
