"""Intervals and points of keys with very many rows: the same results as the plain operators, in bounded tasks.

Keys of at most `most` rows take the plain way of `operators.intervals`. The rows of the others, the hot ones, are
dealt out by time, so that what meets in one task is about `most` rows of a side, however many a key has.

Edge cases: null keys are one key, as in the plain operators. Points without a time attach to nothing. Repeated rows
count each time. Empty tables give empty results. Columns that both sides of a join share are told apart by the
caller, as in `attach_points`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from .intervals import KEYS, attach_points, merge_intervals

HOT_ROWS, BUCKETS, BROADCAST_ROWS = 1_000_000, 4096, 100_000
#: Points of one time that meet a span as one row, about; tasks, at most, that the cells are dealt to.
RUN, TASKS = 32, 2000


def joined(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "inner", small: int | None = None) -> DataFrame:
    """left with right's other columns, null equal to null; right is broadcast if its known row count, `small`, is within the bound."""
    own = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(own[f"__{k}"])
    if small is not None and small <= BROADCAST_ROWS:
        own = F.broadcast(own)
    return left.join(own, on, how).drop(*[f"__{k}" for k in keys])


def merge_intervals_segmented(stays: DataFrame, keys: tuple[str, ...] = KEYS, most: int = HOT_ROWS) -> DataFrame:
    """The episodes of `merge_intervals`, without a window over all stays of a hot key.

    Stays of one key and begin are one row from the start. The rest is dealt into ranges of key and begin; a
    segment is what a range has of a key. Within segments, windows tell how far earlier stays reach; over the ends
    of segments, one row each, a second window tells how far all segments before reach, and a third how many
    episodes they began. So the number of an episode is known in each segment on its own.
    """
    counts = stays.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = stored(counts.filter(F.col("_n") > most))
    n_keys, n_rows = hot.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if not n_keys:
        return merge_intervals(stays, keys)
    marked = joined(stays, hot, keys, "left", n_keys)
    cold = merge_intervals(marked.filter("_n IS NULL").drop("_n"), keys)
    dates = [F.min(c).alias(c) for c in ("admit", "discharge") if c in stays.columns]
    begins = marked.filter("_n IS NOT NULL").groupBy(*keys, "t_in").agg(F.max("t_out").alias("t_out"), F.bool_or("open_end").alias("open_end"), F.count(F.lit(1)).alias("n"), *dates)
    n_segments = -(-n_rows // most)
    dealt = stored(begins.repartitionByRange(n_segments, *keys, "t_in").withColumn("segment", F.spark_partition_id()))
    at, most_ends = (*keys, "segment"), n_segments + n_keys
    before = Window.partitionBy(*keys).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    ends = dealt.groupBy(*at).agg(F.max("t_out").alias("reach"))
    carried = ends.select(*at, F.max("reach").over(before).alias("carried"))
    inside = Window.partitionBy(*at).orderBy("t_in")
    reached = F.max("t_out").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("t_in") > F.greatest(reached, F.col("carried")), F.lit(True)).cast("int")
    flagged = joined(dealt, carried, at, small=most_ends).withColumn("new", new)
    flagged = stored(flagged.withColumn("place", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0))))
    begun = flagged.groupBy(*at).agg(F.sum("new").alias("begun"))
    earlier = begun.select(*at, F.coalesce(F.sum("begun").over(before), F.lit(0)).alias("earlier"))
    numbered = joined(flagged, earlier, at, small=most_ends).withColumn("seq", F.col("place") + F.col("earlier"))
    merged = numbered.groupBy(*keys, "seq").agg(F.min("t_in").alias("t_in"), F.max("t_out").alias("t_out"), F.bool_or("open_end").alias("any_open_end"), F.sum("n").alias("n_intervals"), *dates)
    return cold.unionByName(merged)


def bucket_of(t: Column, lo: Column, width: Column) -> Column:
    """The place of t among equally wide buckets that begin at lo."""
    return F.floor(F.timestamp_diff("MICROSECOND", lo, t) / width).cast("int")


def hot_sides(points: DataFrame, spans: DataFrame, keys: tuple[str, ...], t: str, most: int, buckets: int) -> DataFrame:
    """keys, lo, hi, width of every key that has both points and spans and more than `most` rows of them."""
    p = points.filter(F.col(t).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"), F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    s = spans.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_spans"))
    width = F.floor(F.timestamp_diff("MICROSECOND", F.col("_lo"), F.col("_hi")) / buckets) + 1
    return stored(joined(p, s, keys).filter(F.col("n_points") + F.col("n_spans") > most).select(*keys, "_lo", "_hi", width.alias("_width")))


def time_bins(points: DataFrame, hot: DataFrame, keys: tuple[str, ...], most: int) -> DataFrame:
    """keys, bucket, bin: bins are runs of buckets that hold about `most` points; every bucket of a hot key is there."""
    counts = points.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("n"))
    last = bucket_of(F.col("_hi"), F.col("_lo"), F.col("_width"))
    every = hot.select(*keys, F.explode(F.sequence(F.lit(0), last)).alias("_bucket"))
    filled = joined(every, counts, (*keys, "_bucket"), "left")
    # At most `buckets` rows of a key meet in these windows.
    order = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    share = filled.withColumn("share", F.floor(F.coalesce(F.sum("n").over(order), F.lit(0)) / most))
    return stored(share.select(*keys, "_bucket", F.dense_rank().over(Window.partitionBy(*keys).orderBy("share")).alias("_bin")))


def deal(points: DataFrame, spans: DataFrame, hot: DataFrame, n_hot: int, keys: tuple[str, ...], t: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Points and spans of hot keys with bin, row and column: every pair that can match meets in one cell, and in no other.

    A point lies in one bin, a span in all that it touches. A bin with more than `most` points or spans is a grid:
    a point takes one row of it and all columns, a span one column and all rows.
    """
    own = joined(points.filter(F.col(t).isNotNull()), hot, keys, small=n_hot)
    own = own.withColumn("_bucket", bucket_of(F.col(t), F.col("_lo"), F.col("_width")))
    bins = time_bins(own, hot, keys, most)
    n_bins = bins.count()
    own = stored(joined(own.drop("_lo", "_hi", "_width"), bins, (*keys, "_bucket"), small=n_bins).drop("_bucket"))
    held = joined(spans, hot, keys, small=n_hot).filter((F.col("t_out") >= F.col("_lo")) & (F.col("t_in") <= F.col("_hi")))
    first, last = F.greatest("t_in", "_lo"), F.least("t_out", "_hi")
    for name, at in (("_first_bin", first), ("_last_bin", last)):
        held = held.withColumn("_bucket", bucket_of(at, F.col("_lo"), F.col("_width")))
        held = joined(held, bins.withColumnRenamed("_bin", name), (*keys, "_bucket"), small=n_bins).drop("_bucket")
    held = held.filter(F.col("t_in") <= F.col("t_out")).withColumn("_bin", F.explode(F.sequence("_first_bin", "_last_bin")))
    held = stored(held.drop("_lo", "_hi", "_width", "_first_bin", "_last_bin"))
    cell = (*keys, "_bin")
    split = lambda df, name: df.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    grid = stored(joined(split(own, "_rows"), split(held, "_columns"), cell).withColumn("_grid", F.monotonically_increasing_id()))
    n_grid = grid.count()
    # Numbers are given to rows of stored tables, which are read in the same splits whenever a task runs again.
    own, held = (df.withColumn("_number", F.monotonically_increasing_id()) for df in (own, held))
    own = joined(own, grid, cell, small=n_grid).withColumn("_row", F.pmod("_number", "_rows").cast("int"))
    held = joined(held, grid, cell, small=n_grid).withColumn("_column", F.pmod("_number", "_columns").cast("int"))
    own = own.withColumn("_column", F.explode(F.sequence(F.lit(0), F.col("_columns") - 1)))
    held = held.withColumn("_row", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)))
    return own.drop("_rows", "_columns"), held.drop("_rows", "_columns", "_number")


def attach_runs(points: DataFrame, spans: DataFrame, keys: tuple[str, ...], t: str, most: int) -> DataFrame:
    """The pairs of dealt points and spans. Points of one cell and time are runs of about RUN: a span meets a run once, and runs are taken apart after.

    What a cell costs are its pairs, not its bytes, so cells are dealt to a given number of tasks, which adaptive
    execution leaves as it is. Spans are the left side, which streams: a join holds all pairs of one streamed row
    before it hands them on, here at most the points of a cell, where a run would have RUN pairs with each span.
    """
    cell = ["_grid", "_row", "_column"]
    rest = [c for c in points.columns if c not in (*keys, t, *cell, "_bin", "_number")]
    n_tasks = max(1, min(TASKS, points.select(*cell).distinct().count()))
    run = F.pmod(F.xxhash64("_number"), F.lit(-(-most // RUN))).alias("_run")
    runs = points.repartition(n_tasks, *cell).groupBy(*cell, *keys, t, run).agg(F.collect_list(F.struct(F.lit(True).alias("_point"), *rest)).alias("_points"))
    held = spans.drop(*keys, "_bin").withColumnsRenamed({c: f"_{c}" for c in cell}).repartition(n_tasks, *[f"_{c}" for c in cell])
    on = F.col(t).between(F.col("t_in"), F.col("t_out"))
    for c in cell:
        on = on & (F.col(c) == F.col(f"_{c}"))
    ends = [c for c in spans.columns if c not in (*keys, *cell, "_bin", "_number")]
    return held.join(runs, on).select(*keys, t, *ends, F.inline("_points")).drop("_point")


def attach_points_binned(points: DataFrame, spans: DataFrame, keys: tuple[str, ...] = KEYS, t: str = "t", most: int = HOT_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """The pairs of `attach_points`, each found in one time bin of a hot key."""
    hot = hot_sides(points, spans, keys, t, most, buckets)
    n_hot = hot.count()
    if not n_hot:
        return attach_points(points, spans, keys, t)
    points, spans = stored(points), stored(spans)
    names = hot.select(*keys, F.lit(True).alias("_hot"))
    cold = [joined(df, names, keys, "left", n_hot).filter("_hot IS NULL").drop("_hot") for df in (points, spans)]
    own, held = deal(points, spans, hot, n_hot, keys, t, most)
    return attach_points(*cold, keys, t).unionByName(attach_runs(own, held, keys, t, most))
