"""Intervals: open ends, merging into episodes, attaching points, exposure by month, rows at risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import days_between

KEYS = ("subject", "encounter")


def same_keys(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = KEYS) -> Column:
    """Keyed equality in which null equals null."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def fill_open_end(intervals: DataFrame, end: str = "t_out", fallback: str = "discharge") -> DataFrame:
    """Open ends from the fallback, flagged in open_end; intervals without a positive length go."""
    filled = intervals.withColumns({"open_end": F.col(end).isNull(), end: F.coalesce(end, fallback)})
    return filled.filter(F.col(end) > F.col("t_in"))


def merge_intervals(stays: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Episodes: stays of one key that overlap or touch are one. Adds seq, any_open_end, n_intervals; one shuffle."""
    order = Window.partitionBy(*keys).orderBy("t_in", "t_out")
    reached = F.max("t_out").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reached.isNull() | (F.col("t_in") > reached), 1).otherwise(0)
    numbered = stays.withColumn("new", new).withColumn("seq", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    facts = [F.min(c).alias(c) for c in ("admit", "discharge") if c in stays.columns]
    return numbered.groupBy(*keys, "seq").agg(F.min("t_in").alias("t_in"), F.max("t_out").alias("t_out"), F.bool_or("open_end").alias("any_open_end"), F.count(F.lit(1)).alias("n_intervals"), *facts)


def clip(spans: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Adds clip_in and clip_out, the span inside the study window; spans outside it go."""
    low, high = F.col("t_in"), F.col("t_out")
    if start:
        low = F.greatest(low, F.lit(f"{start} 00:00:00").cast("timestamp_ntz"))
    if end:
        high = F.least(high, F.lit(f"{end} 23:59:59").cast("timestamp_ntz"))
    return spans.withColumns({"clip_in": low, "clip_out": high}).filter("clip_out > clip_in")


def attach_points(points: DataFrame, spans: DataFrame, keys: tuple[str, ...] = KEYS, t: str = "t") -> DataFrame:
    """Every point with every span of its key that holds it, both ends included: keyed join with a residual."""
    held = spans.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in spans.columns])
    on = F.lit(True)
    for k in keys:
        on = on & points[k].eqNullSafe(held[f"_{k}"])
    return points.join(held, on & points[t].between(held["t_in"], held["t_out"])).drop(*[f"_{k}" for k in keys])


def allocate_exposure(spans: DataFrame, low: str = "t_in", high: str = "t_out") -> DataFrame:
    """A row for each month that a span touches, with the days spent in it; only touched months are made."""
    months = F.sequence(F.trunc(F.to_date(low), "month"), F.trunc(F.to_date(high), "month"), F.expr("interval 1 month"))
    rows = spans.filter(F.col(low) <= F.col(high)).withColumn("month", F.explode(months))
    begin = F.greatest(F.col(low), F.col("month").cast("timestamp_ntz"))
    end = F.least(F.col(high), F.add_months("month", 1).cast("timestamp_ntz"))
    return rows.withColumn("days", days_between(begin, end)).filter("days > 0")


def at_risk(spans: DataFrame, days: int, los: str = "los_days") -> DataFrame:
    """day, n_at_risk: spans longer than day - 1 days, for days 1 to `days`."""
    reach = F.least(F.lit(days), F.ceil(F.col(los)).cast("int"))
    return spans.filter(F.col(los) > 0).select(F.explode(F.sequence(F.lit(1), reach)).alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("n_at_risk"))
