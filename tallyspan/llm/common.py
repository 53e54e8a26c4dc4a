"""What the corpus operators share: the shared folder, written intermediate tables, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir. Where that is unset, local mode gets a folder of its own; a cluster, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-tallyspan-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: cuts the lineage, survives lost executors.

    While it is written, batches between Spark and Python hold 4 MB at most (one row at least), for bounded
    memory of the workers and of the executor's buffers.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(key, None)
    conf.set(key, str(4 << 20))
    try:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    finally:
        conf.unset(key) if before is None else conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and the n + 1 offsets of its rows; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]] if len(ends) else raw, ends - ends[0] if len(ends) else np.zeros(1, np.int64)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose text column holds about most_bytes each (one row at least)."""
    if not batch.num_rows:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def in_part(key: Column, part: float) -> Column:
    """True for the part (0 to 1) of all keys that a 64-bit hash picks, even at many billions of rows; all for 1."""
    return F.lit(True) if part >= 1 else F.xxhash64(key) < F.lit(int(part * (1 << 64)) - (1 << 63))


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About `rows` rows of df at most, chosen by a hash of key; all rows where there are fewer."""
    n = df.count()
    return df.filter(in_part(F.col(key), rows / n if n else 1.0))


def without(docs: DataFrame, dropped: DataFrame, on: dict[str, Column], broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of docs that no row of `dropped` equals in the columns of `on` (dropped's name: docs' expression).

    `dropped` is broadcast where it has at most broadcast_rows rows, which leaves the texts where they are;
    beyond that both sides are shuffled.
    """
    names = {c: f"__{c}" for c in on}
    gone = dropped.select([F.col(c).alias(n) for c, n in names.items()])
    if gone.count() <= broadcast_rows:
        gone = F.broadcast(gone)
    condition = F.lit(True)
    for c, n in names.items():
        condition = condition & on[c].eqNullSafe(F.col(n))
    return docs.join(gone, condition, "left_anti")
