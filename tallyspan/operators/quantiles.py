"""Exact interpolated quantiles of one column without a global sort or a buffer of all values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored


def quantiles(df: DataFrame, column: str, shares: dict[str, float], buckets: int = 4096) -> DataFrame:
    """One row: the quantile of `column` at each share, by name; null where there is no value.

    Values are counted by equally wide buckets (a map-side aggregate of at most buckets + 1 rows). Of the buckets that
    hold a wanted rank, at most two a share, the distinct values are counted and ranked, each bucket on its own.
    """
    x = df.select(F.col(column).cast("double").alias("x")).filter("x IS NOT NULL")
    low, high = x.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(name) for name in shares])
    width = (high - low) / buckets or 1.0
    values = x.select(F.floor((F.col("x") - low) / width).alias("bucket"), "x")
    counts = stored(values.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")))
    # One row a bucket, so this window over all of them stays small at any size of df.
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("before", before)
    n = counts.agg(F.sum("n")).first()[0]
    ranks = sorted({rank for share in shares.values() for rank in (int(share * (n - 1)), min(int(share * (n - 1)) + 1, n - 1))})
    wanted = F.exists(F.array(*map(F.lit, ranks)), lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))
    held = values.join(F.broadcast(counts.filter(wanted).drop("n")), "bucket").groupBy("bucket", "before", "x").agg(F.count(F.lit(1)).alias("n"))
    reach = F.col("before") + F.sum("n").over(Window.partitionBy("bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    held = held.withColumn("reach", reach)
    at = {rank: F.min(F.when(F.col("reach") > rank, F.col("x"))).alias(f"r{rank}") for rank in ranks}
    row = held.agg(*at.values())
    out = []
    for name, share in shares.items():
        place = share * (n - 1)
        a, b = F.col(f"r{int(place)}"), F.col(f"r{min(int(place) + 1, n - 1)}")
        out.append((a + (b - a) * (place - int(place))).alias(name))
    return row.select(*out)
