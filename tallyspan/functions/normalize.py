"""Column functions: normalisation, flags, bins, elapsed time and guarded rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text layouts of timestamps, in the order they are tried.
LAYOUTS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy"]
#: Fixed value: names that say that nothing was found.
NEGATIVE_NAME = "(?i)^(no|none|not) .*isolated|no growth|no .* detected|negative for"
#: Upper bounds in hours and labels of the bins of time to the first event.
TIMING_BINS = [(6, "0-6 hours"), (24, "6-24 hours"), (48, "ICU day 2"), (72, "ICU day 3"), (168, "ICU days 4-7")]
TIMING_LAST, TIMING_NONE = "After ICU day 7", "No ICU culture"
PANELS = ["Blood buffy", "Genito urinary tract", "Respiratory tract"]


def norm_ts(x: Column, kind: str) -> Column:
    """A timestamp from a timestamp, an epoch in seconds or (above 1e12) milliseconds, or text; else null."""
    if kind.startswith("timestamp"):
        return x.cast("timestamp")
    if kind in ("int", "bigint", "double", "float"):
        return F.when(x > 1e12, F.timestamp_millis(x.cast("bigint"))).otherwise(F.timestamp_seconds(x))
    text = F.regexp_replace(x, "(?<=[0-9])Z$", "")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(layout)) for layout in LAYOUTS])


def trimmed(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x.cast("string"), r"^\s+|\s+$", "")


def norm_text(x: Column) -> Column:
    return F.lower(trimmed(x))


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def first_known(*columns: Column, default: str = "missing") -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*map(blank_to_null, columns), F.lit(default))


def display_label(x: Column) -> Column:
    """Underscores to spaces, white space squeezed, first letter upper case. Later sentences stay lower case."""
    flat = trimmed(F.regexp_replace(F.regexp_replace(x, "_", " "), r"\s+", " "))
    return F.concat(F.upper(F.substring(flat, 1, 1)), F.lower(F.substring(flat, 2, 1_000_000)))


def try_cast(x: Column, kind: str) -> Column:
    return x.try_cast(kind)


def positive_flag(group: Column, category: Column | None = None, blank_is_missing: bool = False) -> Column:
    """Not null and not a no-growth code; an empty category counts as a result unless blank_is_missing."""
    value = blank_to_null(group)
    if category is not None:
        value = F.coalesce(value, blank_to_null(category) if blank_is_missing else category)
    return F.coalesce(value.isNotNull() & ~value.isin("no_growth", "no growth"), F.lit(False))


def negative_name(x: Column) -> Column:
    return F.coalesce(x, F.lit("")).rlike(NEGATIVE_NAME)


def norm_sir(x: Column) -> Column:
    """Resistant, intermediate or susceptible from its spellings; else the cleaned text."""
    clean = norm_text(x)
    return F.when(clean.isin("r", "resistant", "res"), "resistant").when(clean.isin("i", "intermediate", "intermediate/resistant", "non-susceptible", "nonsusceptible"), "intermediate").when(clean.isin("s", "susceptible", "sus"), "susceptible").otherwise(clean)


def in_window(df: DataFrame, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows from the first second of start to the last second (23:59:59) of end; open where None."""
    if start:
        df = df.filter(F.col(column) >= F.lit(f"{start} 00:00:00").cast("timestamp_ntz"))
    if end:
        df = df.filter(F.col(column) <= F.lit(f"{end} 23:59:59").cast("timestamp_ntz"))
    return df


def of_method(df: DataFrame, method: str, column: str = "method", t: str = "t") -> DataFrame:
    """Rows of one method that have a time."""
    return df.filter((F.col(column) == method) & F.col(t).isNotNull())


def month_of(t: Column) -> Column:
    return F.trunc(F.to_date(t), "month")


def elapsed(unit_us: float, a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / unit_us


def hours_between(a: Column, b: Column) -> Column:
    return elapsed(3.6e9, a, b)


def days_between(a: Column, b: Column) -> Column:
    return elapsed(8.64e10, a, b)


def stay_day(hours: Column) -> Column:
    return (F.floor(hours / 24) + 1).cast("bigint")


def timing_bin(hours: Column) -> tuple[Column, Column]:
    """The label and the order of the bin of the time to the first event; null hours have a bin of their own."""
    label, order = F.when(hours.isNull(), TIMING_NONE), F.when(hours.isNull(), len(TIMING_BINS) + 2)
    for k, (bound, name) in enumerate(TIMING_BINS, 1):
        label, order = label.when(hours < bound, name), order.when(hours < bound, k)
    return label.otherwise(TIMING_LAST), order.otherwise(len(TIMING_BINS) + 1)


def panel_of(x: Column, panels: list[str] = PANELS) -> Column:
    return F.when(x.isin(panels), x).otherwise("Other")


def fold(x: Column, labels: list[str], into: str = "Other") -> Column:
    return F.when(x.isin(labels), into).otherwise(x)


def rate_per(n: Column, d: Column, per: float = 100) -> Column:
    """per * n / d, null where d is 0."""
    return F.try_divide(n * F.lit(float(per)), d)


def composite_id(*parts: Column) -> Column:
    """Parts joined by `|`; null if any is null."""
    out = parts[0].cast("string")
    for p in parts[1:]:
        out = F.concat(out, F.lit("|"), p.cast("string"))
    return out


def n_distinct(*columns: str | Column) -> Column:
    """Distinct values, null counted as one; for several columns, distinct tuples with their nulls."""
    if len(columns) > 1:
        return F.count_distinct(F.struct(*columns))
    x = F.col(columns[0]) if isinstance(columns[0], str) else columns[0]
    return F.count_distinct(x) + F.coalesce(F.max(x.isNull().cast("int")), F.lit(0))


def any_true(x: Column) -> Column:
    return F.coalesce(F.bool_or(x), F.lit(False))


def period_of(t: Column, shift: str) -> Column:
    return F.when(F.to_date(t) < F.lit(shift).cast("date"), "before").otherwise("after")
