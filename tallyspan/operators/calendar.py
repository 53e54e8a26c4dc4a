"""Complete calendars: month spines, three forms of gap filling, gap reports, label lumping and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored


def month_spine(*months: DataFrame) -> DataFrame:
    """All months between the first and the last of the given month columns: one aggregate, no collect."""
    bounds = None
    for m in months:
        own = m.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
        bounds = own if bounds is None else bounds.unionByName(own)
    bounds = bounds.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo IS NOT NULL")
    return bounds.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month"))


def grid(spine: DataFrame, labels: DataFrame) -> DataFrame:
    """Every month with every row of labels; a spine has some hundred rows, so it is the side that is copied."""
    return labels.crossJoin(F.broadcast(spine))


def levels(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """A fixed list of labels as a frame."""
    return df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(column))


def complete(counts: DataFrame, cells: DataFrame, keys: list[str], fill: dict[str, object]) -> DataFrame:
    """counts with a row for every cell: a full join, so rows outside the cells stay; fill replaces nulls."""
    left = cells.select(*[F.col(k).alias(f"_{k}") for k in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"_{k}").eqNullSafe(F.col(k))
    joined = left.withColumn("_cell", F.lit(1)).join(counts.withColumn("_row", F.lit(1)), on, "full")
    out = [F.when(F.col("_row").isNull(), F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    rest = [F.coalesce(F.col(c), F.lit(fill[c])).alias(c) if c in fill else F.col(c) for c in counts.columns if c not in keys]
    return joined.select(*out, *rest)


def missing_cells(cells: DataFrame, data: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that have no row in data."""
    return cells.join(data.select(keys).distinct(), keys, "left_anti")


def top_labels(df: DataFrame, label: str, n: int) -> DataFrame:
    """The n most frequent labels; ties in the order of the label, null last."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(label)).limit(n)


def lump(df: DataFrame, label: str, top: DataFrame, other: str = "Other") -> DataFrame:
    """Labels outside top become `other`. top is a head of n rows."""
    kept = top.select(F.col(label).alias("_top"))
    return df.join(F.broadcast(kept), F.col(label) == F.col("_top"), "left").withColumn(label, F.coalesce("_top", F.lit(other))).drop("_top")


def keep_top(df: DataFrame, label: str, top: DataFrame) -> DataFrame:
    return df.join(F.broadcast(top.select(label)), label, "left_semi")


def top_within(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each group in the given order, with rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= n)


def ranked_within(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """Every row with its rank in its group and n_in_group, the number of rows of the group."""
    return df.withColumns({"rank": F.row_number().over(Window.partitionBy(group).orderBy(*order)), "n_in_group": F.count(F.lit(1)).over(Window.partitionBy(group))})


def at_least(df: DataFrame, n: str, least: int) -> DataFrame:
    """Rows whose count reaches the least that may be shown; null counts don't."""
    return df.filter(F.col(n) >= least)


def with_share(df: DataFrame, group: str, n: str = "n_events") -> DataFrame:
    """share of n in its group's total."""
    return df.withColumn("share", F.try_divide(F.col(n).cast("double"), F.sum(n).over(Window.partitionBy(group))))


def running_sum(x: str, group: list[str], order: str) -> Column:
    return F.sum(x).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def trailing_mean(x: str, group: list[str], order: str, k: int = 6) -> Column:
    """Mean of the last k rows; null until there are k, and where one of them is null."""
    frame = Window.partitionBy(*group).orderBy(order).rowsBetween(1 - k, 0)
    return F.when(F.count(x).over(frame) == k, F.avg(x).over(frame))


def with_level(df: DataFrame, label: str, n: str, last: str = "Other") -> DataFrame:
    """level: the place of each label for display, by its total of n from large to small, with `last` at the end."""
    totals = df.groupBy(label).agg(F.sum(n).alias("_n"))
    order = Window.orderBy(F.coalesce(F.col(label) == last, F.lit(False)), F.desc("_n"), F.asc_nulls_last(label))
    # One row a label; Spark broadcasts them where they are small.
    levels_ = totals.select(F.col(label).alias("_label"), F.row_number().over(order).alias("level"))
    return df.join(levels_, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")


def with_place(df: DataFrame, *order: Column) -> DataFrame:
    """place: the number of each row in the given order, from 1; the order should decide every tie.

    Rows are dealt into ranges and sorted in each; a row's place is its number in its range and the rows of all
    ranges before. One row a range is all that meets in one task.
    """
    number = F.monotonically_increasing_id()
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.shiftright(number, 33).alias("_range"), number.bitwiseAND((1 << 33) - 1).alias("_number")))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row a range, as many as there are shuffle partitions.
    out = ranged.join(F.broadcast(sizes.select("_range", earlier.alias("_before"))), "_range")
    return out.withColumn("place", F.col("_before") + F.col("_number") + 1).drop("_range", "_number", "_before")


def unmapped(df: DataFrame, label: str, known: list[str]) -> DataFrame:
    """The labels of df that a mapping does not name, each once."""
    return df.select(label).distinct().join(F.broadcast(levels(df, label, known)), label, "left_anti")
