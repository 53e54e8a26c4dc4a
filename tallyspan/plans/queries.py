"""The registered queries, each a composition of the library's operators, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normalize import days_between, fold, in_window, month_of, n_distinct, negative_name, norm_sir, panel_of, period_of, rate_per, timing_bin
from ..functions.taxonomy import classify, pattern_group, phenotype, tag_targets
from ..operators import calendar as cal
from ..operators.intervals import allocate_exposure, at_risk, clip
from ..operators.nested import nested_counts
from ..operators.quantiles import quantiles
from ..operators.skew import attach_points_binned, merge_intervals_segmented
from ..operators.trend import trend_screen
from ..sources.store import stored
from .frames import HOURLY_SQL, MONTHLY_SQL, NAMED_SQL, SKEWED_SQL, STUDY, Frames, hourly_binding, monthly_binding, named_binding, skewed_binding

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: The SQL that defines the frames of each binding.
PREFIXES = {monthly_binding: MONTHLY_SQL, hourly_binding: HOURLY_SQL, skewed_binding: SKEWED_SQL, named_binding: NAMED_SQL}
PANELS = ["1-urgent", "2-high", "3-medium"]
#: Targets and phenotypes over the names of the bound tables.
TARGETS = [("Ring", r"\bring\b"), ("Bolt", "bolt"), ("Screw", "screw"), ("Metal", "steel|brass|copper|tin|nickel")]
PHENOTYPES = [("R1", "bolt|ring", "brand#1"), ("R2", "screw|nut", "brand#2"), ("R3", ".", "brand#3")]
CLASS_RULES = [("Small", "small|mini"), ("Standard", "standard|medium"), ("Large", "large|promo")]
HOURS, DAYS, TOP = 168, 14, 5


def register(name: str, frames: Callable[[SparkSession, str], Frames], sql: str | None = None) -> Callable:
    """Registers a function of Frames as a query; sql follows the binding's prefix."""
    prefix = PREFIXES[frames]

    def add(build: Callable[[Frames], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, d: dates_as_timestamps(build(frames(spark, d)))
        if sql:
            SQL[name] = prefix + sql
        return build

    return add


def dates_as_timestamps(df: DataFrame) -> DataFrame:
    """Dates as timestamps without zone, which both engines print alike."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in df.dtypes if kind == "date"})


# Intervals and events


@register("merge_intervals", monthly_binding, "z AS (SELECT 1) SELECT encounter, seq, t_in, t_out, any_open_end, n_intervals FROM episodes")
def _(f: Frames) -> DataFrame:
    return f.episodes.select("encounter", "seq", "t_in", "t_out", "any_open_end", "n_intervals")


_ATTACHED = "encounter, t, type, organism_id, t_in, t_out"


@register("attach_points_episodes", monthly_binding, f"z AS (SELECT 1) SELECT {_ATTACHED} FROM attached")
def _(f: Frames) -> DataFrame:
    return f.attached.select(*_ATTACHED.split(", "))


@register("attach_points_intervals", monthly_binding, "z AS (SELECT 1) SELECT p.encounter, p.t, p.type, p.organism_id, s.t_in, s.t_out FROM points p JOIN stays s ON p.encounter = s.encounter AND p.t BETWEEN s.t_in AND s.t_out")
def _(f: Frames) -> DataFrame:
    return f.attached_stays.select(*_ATTACHED.split(", "))


#: Rows of a key from which on it counts as hot; low, so that the small tables have a hot key too.
HOT = 2000


@register("merge_intervals_hot", skewed_binding, "z AS (SELECT 1) SELECT encounter, seq, t_in, t_out, any_open_end, n_intervals FROM episodes")
def _(f: Frames) -> DataFrame:
    """Episodes where one encounter holds a third of all stays: merged by segments of time."""
    return merge_intervals_segmented(f.stays, most=HOT).select("encounter", "seq", "t_in", "t_out", "any_open_end", "n_intervals")


@register("attach_points_hot", skewed_binding, "z AS (SELECT 1) SELECT p.encounter, p.t, p.type, p.organism_id, s.t_in, s.t_out FROM points p JOIN stays s ON p.encounter = s.encounter AND p.t BETWEEN s.t_in AND s.t_out")
def _(f: Frames) -> DataFrame:
    """Points in unmerged stays where one encounter holds a third of both: every pair in one cell of one time bin."""
    return attach_points_binned(f.points.select("subject", "encounter", "t", "type", "organism_id"), f.stays.select("subject", "encounter", "t_in", "t_out"), most=HOT).select(*_ATTACHED.split(", "))


@register("events_full_key", monthly_binding, "z AS (SELECT 1) SELECT encounter, seq, t, type, name, n_rows, any_positive, organism_groups, month, round(hours, 6) AS hours, day FROM events_")
def _(f: Frames) -> DataFrame:
    return f.events.select("encounter", "seq", "t", "type", "name", "n_rows", "any_positive", "organism_groups", "month", F.round("hours", 6).alias("hours"), "day")


@register("specimen_summary", monthly_binding, """z AS (SELECT 1)
SELECT type, name, count(*) AS n_rows, count(DISTINCT (encounter, seq, t)) AS n_events, count(*) FILTER (WHERE positive) AS n_positive,
  count(DISTINCT encounter) AS n_encounters, count(DISTINCT subject) AS n_subjects
FROM attached GROUP BY type, name""")
def _(f: Frames) -> DataFrame:
    return f.attached.groupBy("type", "name").agg(
        F.count(F.lit(1)).alias("n_rows"),
        n_distinct("encounter", "seq", "t").alias("n_events"),
        F.count_if("positive").alias("n_positive"),
        n_distinct("encounter").alias("n_encounters"),
        n_distinct("subject").alias("n_subjects"),
    )


@register("cohort_encounters", monthly_binding, "z AS (SELECT DISTINCT encounter FROM attached) SELECT encounter, admit, discharge FROM z JOIN enc USING (encounter)")
def _(f: Frames) -> DataFrame:
    return f.attached.select("encounter").distinct().join(f.encounters.select("encounter", "admit", "discharge"), "encounter", "left")


@register("cohort_spans", monthly_binding, "z AS (SELECT 1) SELECT DISTINCT p.encounter, s.t_in, s.t_out FROM points p JOIN stays s ON p.encounter = s.encounter AND p.t BETWEEN s.t_in AND s.t_out")
def _(f: Frames) -> DataFrame:
    return f.attached_stays.select("encounter", "t_in", "t_out").distinct()


@register("cohort_summary", monthly_binding, """a AS (
  SELECT p.*, s.t_in, s.t_out FROM points p JOIN stays s ON p.encounter = s.encounter AND p.t BETWEEN s.t_in AND s.t_out),
e AS (SELECT encounter, t_in, t_out, t, type, name, bool_or(positive) AS any_positive FROM a GROUP BY ALL)
SELECT count(DISTINCT subject) AS n_subjects, count(DISTINCT encounter) AS n_encounters, count(DISTINCT (encounter, t_in, t_out)) AS n_intervals,
  count(*) AS n_rows, (SELECT count(*) FROM e) AS n_events, count(*) FILTER (WHERE positive) AS n_positive_rows,
  (SELECT count(*) FILTER (WHERE any_positive) FROM e) AS n_positive_events, count(DISTINCT type) AS n_categories,
  count(DISTINCT organism_group) AS n_groups, count(t) AS n_rows_with_time, date_trunc('day', min(t)) AS first_date, date_trunc('day', max(t)) AS last_date
FROM a""")
def _(f: Frames) -> DataFrame:
    """Twelve measures of the cohort, the rows attached to unmerged stays; distinct counts run over collapsed rows."""
    event = ["subject", "encounter", "t_in", "t_out", "t", "type", "name", "method"]
    cells = f.attached_stays.groupBy(*event, "organism_group").agg(F.count(F.lit(1)).alias("n"), F.count_if("positive").alias("n_positive"))
    cells = stored(cells)
    totals = cells.agg(
        n_distinct("subject").alias("n_subjects"),
        n_distinct("encounter").alias("n_encounters"),
        n_distinct("encounter", "t_in", "t_out").alias("n_intervals"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("n_positive"), F.lit(0)).alias("n_positive_rows"),
        F.count_distinct("type").alias("n_categories"),
        F.count_distinct("organism_group").alias("n_groups"),
        F.coalesce(F.sum(F.when(F.col("t").isNotNull(), F.col("n"))), F.lit(0)).alias("n_rows_with_time"),
        F.to_date(F.min("t")).alias("first_date"),
        F.to_date(F.max("t")).alias("last_date"),
    )
    events = cells.groupBy(*event).agg((F.sum("n_positive") > 0).alias("any_positive"))
    return totals.crossJoin(events.agg(F.count(F.lit(1)).alias("n_events"), F.count_if("any_positive").alias("n_positive_events")))


@register("events_per_subject", monthly_binding, """s AS (SELECT subject, count(*) AS n_events FROM events_ GROUP BY 1),
e AS (SELECT encounter, count(*) AS n_events FROM events_ GROUP BY 1)
SELECT 'subject' AS level, n_events, count(*) AS n FROM s GROUP BY 2 UNION ALL SELECT 'encounter', n_events, count(*) FROM e GROUP BY 2""")
def _(f: Frames) -> DataFrame:
    """How many subjects, and how many encounters, have each number of events."""
    each = stored(f.events.groupBy("subject", "encounter").agg(F.count(F.lit(1)).alias("n_events")))
    subjects = each.groupBy("subject").agg(F.sum("n_events").alias("n_events")).select(F.lit("subject").alias("level"), "n_events")
    return subjects.unionByName(each.select(F.lit("encounter").alias("level"), "n_events")).groupBy("level", "n_events").agg(F.count(F.lit(1)).alias("n"))


# Exposure


def days_by_month(f: Frames) -> DataFrame:
    """month, n_days, n_contributing of the clipped episodes."""
    rows = allocate_exposure(clip(f.frame("episodes"), *STUDY).drop("month"), "clip_in", "clip_out")
    return rows.groupBy("month").agg(F.sum("days").alias("n_days"), F.count(F.lit(1)).alias("n_contributing"))


_CLIPPED = f"""clipped AS (SELECT *, greatest(t_in, TIMESTAMP '{STUDY[0]} 00:00:00') AS ci, least(t_out, TIMESTAMP '{STUDY[1]} 23:59:59') AS co FROM episodes),
split AS (SELECT encounter, seq, m.month, date_diff('microsecond', greatest(ci, m.month), least(co, m.month + INTERVAL 1 MONTH)) / 8.64e10 AS days
  FROM clipped, (SELECT unnest(generate_series(TIMESTAMP '{STUDY[0][:8]}01', TIMESTAMP '{STUDY[1]}', INTERVAL 1 MONTH)) AS month) m WHERE ci < co AND ci < m.month + INTERVAL 1 MONTH AND co > m.month),
exposure AS (SELECT month, sum(days) AS n_days, count(*) AS n_contributing FROM split GROUP BY 1),
adm AS (SELECT month, count(*) AS n_episodes FROM episodes WHERE t_in BETWEEN TIMESTAMP '{STUDY[0]} 00:00:00' AND TIMESTAMP '{STUDY[1]} 23:59:59' GROUP BY 1),
clipadm AS (SELECT date_trunc('month', ci) AS month, count(*) AS n_episodes FROM clipped WHERE ci < co GROUP BY 1),
"""


@register("monthly_episodes_admitted", monthly_binding, _CLIPPED + "z AS (SELECT 1) SELECT month, n_episodes FROM adm")
def _(f: Frames) -> DataFrame:
    counts = stored(in_window(f.episodes, "t_in", *STUDY).groupBy("month").agg(F.count(F.lit(1)).alias("n_episodes")))
    return cal.complete(counts, cal.month_spine(counts), ["month"], {"n_episodes": 0})


@register("monthly_episode_days", monthly_binding, _CLIPPED + "z AS (SELECT 1) SELECT month, round(n_days, 6) AS n_days, n_contributing FROM exposure")
def _(f: Frames) -> DataFrame:
    return days_by_month(f).select("month", F.round("n_days", 6).alias("n_days"), "n_contributing")


def denominators(f: Frames) -> DataFrame:
    """month, n_episodes (by clipped admission), n_days on one spine; one pass over the episodes."""
    rows = allocate_exposure(clip(f.frame("episodes"), *STUDY).drop("month"), "clip_in", "clip_out")
    began = F.col("month") == month_of(F.col("clip_in"))
    counts = stored(rows.groupBy("month").agg(F.count_if(began).alias("n_episodes"), F.sum("days").alias("n_days")))
    return cal.complete(counts, cal.month_spine(counts), ["month"], {"n_episodes": 0, "n_days": 0.0})


@register("monthly_denominators_clipped", monthly_binding, _CLIPPED + "z AS (SELECT 1) SELECT month, coalesce(n_episodes, 0) AS n_episodes, round(coalesce(n_days, 0), 6) AS n_days FROM exposure FULL JOIN clipadm USING (month)")
def _(f: Frames) -> DataFrame:
    return denominators(f).withColumn("n_days", F.round("n_days", 6))


# Monthly counts and rates

_SPINE = "b AS (SELECT min(month) AS lo, max(month) AS hi FROM events_), spine AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS month FROM b),\n"
_TOP_TYPES = "top AS (SELECT type FROM (SELECT type, count(*) AS n FROM events_ GROUP BY 1 ORDER BY n DESC, type LIMIT 3))"
_TOP = _TOP_TYPES + ", lumped AS (SELECT e.* EXCLUDE (type), coalesce(top.type, 'Other') AS type FROM events_ e LEFT JOIN top USING (type)),\n"


def event_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Events, positive events, and the episodes, encounters and subjects that have one."""
    levels = {"n_subjects": ["subject"], "n_encounters": ["encounter"], "n_episodes_with": ["seq"]}
    counts = nested_counts(df, list(keys), levels, {"n_events": F.lit(1), "n_positive": F.coalesce(F.col("any_positive"), F.lit(False))})
    return counts.select(*keys, *MEASURES)


MEASURES = ["n_events", "n_positive", "n_episodes_with", "n_encounters", "n_subjects"]
ZERO = dict.fromkeys(MEASURES, 0)
PLAIN = ["n_events", "n_positive", "n_encounters", "n_subjects"]
_COUNTS = """count(*) AS n_events, count(*) FILTER (WHERE any_positive) AS n_positive, count(DISTINCT (encounter, seq)) AS n_episodes_with,
  count(DISTINCT encounter) AS n_encounters, count(DISTINCT subject) AS n_subjects"""
_ZEROS = ", ".join(f"coalesce({m}, 0) AS {m}" for m in MEASURES)
_PLAIN = ", ".join(f"coalesce({m}, 0) AS {m}" for m in PLAIN) + ", round(CASE WHEN n_events > 0 THEN 100.0 * n_positive / n_events END, 6) AS percent_positive"


def plain(df: DataFrame, *keys: str) -> DataFrame:
    """keys, the counts and the positive share."""
    return df.select(*keys, *PLAIN, F.round(rate_per(F.col("n_positive"), F.col("n_events")), 6).alias("percent_positive"))


def per(df: DataFrame, denominator: str, **rates: str) -> DataFrame:
    """A rounded rate per 100 of the denominator for each name = count."""
    return df.withColumns({name: F.round(rate_per(F.col(n), F.col(denominator)), 6) for name, n in rates.items()})


def _rate(n: str, d: str) -> str:
    return f"round(CASE WHEN {d} > 0 THEN 100.0 * coalesce({n}, 0) / {d} END, 6)"


@register("monthly_overall", monthly_binding, f"z AS (SELECT month, {_COUNTS} FROM events_ GROUP BY month) SELECT month, {_PLAIN} FROM z")
def _(f: Frames) -> DataFrame:
    return plain(event_counts(f.events, "month"), "month")


def by_type(f: Frames, n: int = 3) -> DataFrame:
    """Events with the type lumped to the n most frequent."""
    events = f.once("events")
    return cal.lump(events, "type", cal.top_labels(events, "type", n))


def filled(counts: DataFrame, label: str, fill: dict = ZERO) -> DataFrame:
    """counts completed over all months and the labels seen."""
    counts = stored(counts)
    return cal.complete(counts, cal.grid(cal.month_spine(counts), counts.select(label).distinct()), ["month", label], fill)


_FILLED = _SPINE + _TOP + f"""c AS (SELECT month, type, {_COUNTS} FROM lumped GROUP BY 1, 2),
g AS (SELECT month, type FROM spine, (SELECT DISTINCT type FROM c)), r AS (SELECT month, type, {_ZEROS} FROM g LEFT JOIN c USING (month, type)) """


@register("monthly_by_type", monthly_binding, _FILLED + f"SELECT month, type, {_PLAIN} FROM r")
def _(f: Frames) -> DataFrame:
    return plain(filled(event_counts(by_type(f), "month", "type"), "type"), "month", "type")


@register("monthly_by_type_ordered", monthly_binding, _FILLED.rstrip() + """, l AS (
  SELECT type, CAST(row_number() OVER (ORDER BY type = 'Other', sum(n_events) DESC, type) AS INTEGER) AS level FROM r GROUP BY 1)
SELECT month, type, level, n_events, CAST(row_number() OVER (ORDER BY month, level) AS INTEGER) AS place FROM r JOIN l USING (type)""")
def _(f: Frames) -> DataFrame:
    """Display order: months, in each the types by their totals with Other last; a report of months x types rows."""
    out = cal.with_level(filled(event_counts(by_type(f), "month", "type"), "type"), "type", "n_events")
    return cal.with_place(out.select("month", "type", "level", "n_events"), F.asc("month"), F.asc("level")).withColumn("place", F.col("place").cast("int"))


@register("unmapped_labels", monthly_binding, "z AS (SELECT 1) SELECT DISTINCT type FROM points WHERE type NOT IN ('1-urgent', '2-high', '3-medium')")
def _(f: Frames) -> DataFrame:
    return cal.unmapped(f.points, "type", PANELS)


@register("monthly_restacked", monthly_binding, f"""z AS (SELECT * REPLACE (CASE WHEN type IN ('4-not specified', '5-low') THEN 'Other' ELSE type END AS type) FROM events_),
y AS (SELECT month, type, {_COUNTS} FROM z GROUP BY 1, 2) SELECT month, type, {_PLAIN} FROM y""")
def _(f: Frames) -> DataFrame:
    return plain(event_counts(f.events.withColumn("type", fold(F.col("type"), ["4-not specified", "5-low"])), "month", "type"), "month", "type")


@register("monthly_positivity_by_category", monthly_binding, _SPINE + _TOP_TYPES + f""",
c AS (SELECT month, type, {_COUNTS} FROM events_ WHERE type IN (SELECT type FROM top) GROUP BY 1, 2)
SELECT month, type, {_PLAIN} FROM (SELECT month, type FROM spine, top) LEFT JOIN c USING (month, type)""")
def _(f: Frames) -> DataFrame:
    events = f.once("events")
    top = stored(cal.top_labels(events, "type", 3))
    counts = event_counts(cal.keep_top(events, "type", top), "month", "type")
    return plain(cal.complete(counts, cal.grid(cal.month_spine(events), top.select("type")), ["month", "type"], ZERO), "month", "type")


def panels(events: DataFrame) -> DataFrame:
    """Each event under Overall and under its panel, in one pass."""
    return events.withColumn("panel", F.explode(F.array(F.lit("Overall"), panel_of(F.col("type"), PANELS))))


_PANELS = "p AS (SELECT *, unnest(['Overall', CASE WHEN type IN ('1-urgent', '2-high', '3-medium') THEN type ELSE 'Other' END]) AS panel FROM events_),\n"


@register("monthly_five_panel", monthly_binding, _SPINE + _PANELS + f"""c AS (SELECT month, panel, {_COUNTS} FROM p GROUP BY 1, 2),
l AS (SELECT unnest(['Overall', '1-urgent', '2-high', '3-medium', 'Other']) AS panel)
SELECT month, panel, {_PLAIN} FROM (SELECT * FROM spine, l) LEFT JOIN c USING (month, panel)""")
def _(f: Frames) -> DataFrame:
    counts = stored(event_counts(panels(f.events), "month", "panel"))
    cells = cal.grid(cal.month_spine(counts), cal.levels(counts, "panel", ["Overall", *PANELS, "Other"]))
    return plain(cal.complete(counts, cells, ["month", "panel"], ZERO), "month", "panel")


@register("event_density", monthly_binding, _PANELS + """c AS (SELECT panel, month, count(*) AS n_events FROM p GROUP BY 1, 2)
SELECT panel, month, n_events, round(n_events / sum(n_events) OVER (PARTITION BY panel), 6) AS share, round(n_events / max(n_events) OVER (PARTITION BY panel), 6) AS scaled FROM c""")
def _(f: Frames) -> DataFrame:
    counts = panels(f.events).groupBy("panel", "month").agg(F.count(F.lit(1)).alias("n_events"))
    scaled = F.try_divide(F.col("n_events").cast("double"), F.max("n_events").over(Window.partitionBy("panel")))
    return cal.with_share(counts, "panel").withColumns({"share": F.round("share", 6), "scaled": F.round(scaled, 6)})


_ADM = "adm AS (SELECT month, count(*) AS n_episodes FROM episodes GROUP BY 1), b2 AS (SELECT least((SELECT min(month) FROM events_), (SELECT min(month) FROM adm)) AS lo, greatest((SELECT max(month) FROM events_), (SELECT max(month) FROM adm)) AS hi), sp AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS month FROM b2),\n"


def episode_counts(f: Frames) -> DataFrame:
    return f.frame("episodes").groupBy("month").agg(F.count(F.lit(1)).alias("n_episodes"))


@register("monthly_overall_rates", monthly_binding, _ADM + f"""c AS (SELECT month, {_COUNTS} FROM events_ GROUP BY 1)
SELECT month, coalesce(n_events, 0) AS n_events, coalesce(n_positive, 0) AS n_positive, coalesce(n_episodes_with, 0) AS n_episodes_with,
  coalesce(n_episodes, 0) AS n_episodes, {_rate("n_events", "n_episodes")} AS events_per_100, {_rate("n_positive", "n_episodes")} AS positive_per_100,
  {_rate("n_episodes_with", "n_episodes")} AS with_event_per_100
FROM sp LEFT JOIN c USING (month) LEFT JOIN adm USING (month)""")
def monthly_overall_rates(f: Frames) -> DataFrame:
    f.once("episodes")
    counts, episodes = stored(event_counts(f.events, "month").drop("n_encounters", "n_subjects")), stored(episode_counts(f))
    out = cal.complete(counts, cal.month_spine(counts, episodes), ["month"], ZERO)
    out = out.join(F.broadcast(episodes), "month", "left").withColumn("n_episodes", F.coalesce("n_episodes", F.lit(0)))
    return per(out, "n_episodes", events_per_100="n_events", positive_per_100="n_positive", with_event_per_100="n_episodes_with")


@register("monthly_type_rates", monthly_binding, _FILLED.rstrip() + f""", adm AS (SELECT month, count(*) AS n_episodes FROM episodes GROUP BY 1)
SELECT month, type, n_events, n_episodes_with, coalesce(n_episodes, 0) AS n_episodes, {_rate("n_events", "n_episodes")} AS events_per_100,
  {_rate("n_episodes_with", "n_episodes")} AS with_type_per_100 FROM r LEFT JOIN adm USING (month)""")
def _(f: Frames) -> DataFrame:
    f.once("episodes")
    out = filled(event_counts(by_type(f), "month", "type"), "type").select("month", "type", "n_events", "n_episodes_with")
    out = out.join(F.broadcast(episode_counts(f)), "month", "left").withColumn("n_episodes", F.coalesce("n_episodes", F.lit(0)))
    return per(out, "n_episodes", events_per_100="n_events", with_type_per_100="n_episodes_with")


_RESULTS = f"""rc AS (SELECT month, CASE WHEN any_positive THEN 'positive' ELSE 'negative' END AS result, {_COUNTS} FROM events_ GROUP BY 1, 2),
adm AS (SELECT month, count(*) AS n_episodes FROM episodes GROUP BY 1),
rr AS (SELECT month, result, {_ZEROS}, n_episodes FROM (SELECT month, unnest(['positive', 'negative']) AS result FROM spine) LEFT JOIN rc USING (month, result) LEFT JOIN adm USING (month))"""


def result_rates(f: Frames) -> DataFrame:
    """month, result, events and episodes with that result, episodes."""
    f.once("episodes")
    counts = stored(event_counts(f.events.withColumn("result", F.when(F.col("any_positive"), "positive").otherwise("negative")), "month", "result"))
    cells = cal.grid(cal.month_spine(counts), cal.levels(counts, "result", ["positive", "negative"]))
    return cal.complete(counts, cells, ["month", "result"], ZERO).join(F.broadcast(episode_counts(f)), "month", "left")


@register("monthly_result_rates", monthly_binding, _SPINE + _RESULTS + f"""
SELECT month, result, n_events, n_episodes_with, {_rate("n_events", "n_episodes")} AS events_per_100, {_rate("n_episodes_with", "n_episodes")} AS with_result_per_100 FROM rr""")
def _(f: Frames) -> DataFrame:
    out = per(result_rates(f), "n_episodes", events_per_100="n_events", with_result_per_100="n_episodes_with")
    return out.select("month", "result", "n_events", "n_episodes_with", "events_per_100", "with_result_per_100")


@register("monthly_overall_rates_days", monthly_binding, _CLIPPED + _SPINE + f"""c AS (SELECT month, {_COUNTS} FROM events_ GROUP BY 1)
SELECT month, coalesce(n_events, 0) AS n_events, coalesce(n_positive, 0) AS n_positive, round(n_days, 6) AS n_days,
  {_rate("n_events", "n_days")} AS events_per_100_days, {_rate("n_positive", "n_days")} AS positive_per_100_days
FROM spine LEFT JOIN c USING (month) LEFT JOIN exposure USING (month)""")
def _(f: Frames) -> DataFrame:
    f.once("episodes")
    counts = stored(event_counts(f.events, "month").select("month", "n_events", "n_positive"))
    out = cal.complete(counts, cal.month_spine(counts), ["month"], ZERO).join(F.broadcast(days_by_month(f).select("month", "n_days")), "month", "left")
    return per(out, "n_days", events_per_100_days="n_events", positive_per_100_days="n_positive").withColumn("n_days", F.round("n_days", 6))


@register("monthly_type_rates_days", monthly_binding, _CLIPPED + _FILLED + f"""SELECT month, type, n_events, n_positive, {_rate("n_events", "n_days")} AS events_per_100_days,
  {_rate("n_positive", "n_days")} AS positive_per_100_days FROM r LEFT JOIN exposure USING (month)""")
def _(f: Frames) -> DataFrame:
    f.once("episodes")
    out = filled(event_counts(by_type(f), "month", "type"), "type").select("month", "type", "n_events", "n_positive")
    out = out.join(F.broadcast(days_by_month(f).select("month", "n_days")), "month", "left")
    return per(out, "n_days", events_per_100_days="n_events", positive_per_100_days="n_positive").drop("n_days")


@register("series_digest", monthly_binding, _SPINE + _RESULTS + """,
o AS (SELECT month, sum(n_events) AS n, any_value(n_episodes) AS n_episodes FROM rr GROUP BY 1),
u AS (SELECT 'overall' AS series, month, CAST(n AS DOUBLE) AS x FROM o UNION ALL SELECT result, month, CAST(n_events AS DOUBLE) FROM rr
  UNION ALL SELECT 'episodes', month, CAST(n_episodes AS DOUBLE) FROM o UNION ALL SELECT 'events per 100', month, CASE WHEN n_episodes > 0 THEN 100.0 * n / n_episodes END FROM o)
SELECT series, min(month) AS first_month, max(month) AS last_month, round(sum(x), 6) AS total, round(median(x), 6) AS median_x, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x
FROM u GROUP BY 1""")
def _(f: Frames) -> DataFrame:
    """First and last month, total, median, least and most of the monthly events, in all and by result, of episodes and of the rate."""
    rows = stored(result_rates(f).select("month", "result", "n_events", "n_episodes"))
    overall = rows.groupBy("month").agg(F.sum("n_events").cast("double").alias("n"), F.first("n_episodes").alias("e"))
    parts = F.array(
        F.struct(F.lit("overall").alias("series"), F.col("n").alias("x")),
        F.struct(F.lit("episodes").alias("series"), F.col("e").cast("double").alias("x")),
        F.struct(F.lit("events per 100").alias("series"), rate_per(F.col("n"), F.col("e")).alias("x")),
    )
    series = overall.select("month", F.inline(parts)).unionByName(rows.select("month", F.col("result").alias("series"), F.col("n_events").cast("double").alias("x")))
    facts = {"total": F.sum("x"), "median_x": F.percentile("x", F.lit(0.5)), "min_x": F.min("x"), "max_x": F.max("x")}
    return series.groupBy("series").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), *[F.round(v, 6).alias(k) for k, v in facts.items()])


@register("missing_cells", monthly_binding, _SPINE + "l AS (SELECT DISTINCT encounter, type FROM events_), g AS (SELECT DISTINCT month, organism_category AS label FROM detections) SELECT month, label FROM (SELECT month, label FROM spine, (SELECT DISTINCT label FROM g)) EXCEPT SELECT month, label FROM g")
def _(f: Frames) -> DataFrame:
    f.once("attached")
    seen = stored(f.detections.select("month", F.col("organism_category").alias("label")).distinct())
    return cal.missing_cells(cal.grid(cal.month_spine(f.events), seen.select("label").distinct()), seen, ["month", "label"])


@register("site_pooled_rates", monthly_binding, "e AS (SELECT CAST(CAST(encounter AS BIGINT) % 3 AS VARCHAR) AS site, month, count(*) AS n_events FROM events_ GROUP BY 1, 2), d AS (SELECT CAST(CAST(encounter AS BIGINT) % 3 AS VARCHAR) AS site, month, count(*) AS n_episodes FROM episodes GROUP BY 1, 2) SELECT month, CAST(sum(coalesce(n_events, 0)) AS BIGINT) AS n_events, CAST(sum(n_episodes) AS BIGINT) AS n_episodes, count(*) AS n_sites, round(100.0 * sum(coalesce(n_events, 0)) / sum(n_episodes), 6) AS events_per_100 FROM d LEFT JOIN e USING (site, month) GROUP BY month")
def _(f: Frames) -> DataFrame:
    f.once("episodes")
    site = (F.col("encounter").cast("bigint") % 3).cast("string").alias("site")
    events = f.events.groupBy(site, "month").agg(F.count(F.lit(1)).alias("n_events"))
    sites = f.frame("episodes").groupBy(site, "month").agg(F.count(F.lit(1)).alias("n_episodes")).join(events, ["site", "month"], "left")
    out = sites.groupBy("month").agg(F.sum(F.coalesce("n_events", F.lit(0))).alias("n_events"), F.sum("n_episodes").alias("n_episodes"), F.count(F.lit(1)).alias("n_sites"))
    return out.withColumn("events_per_100", F.round(rate_per(F.col("n_events"), F.col("n_episodes")), 6))


# Shift of categories; straight from the point rows


@register("category_ranges", monthly_binding, "z AS (SELECT 1) SELECT type, count(*) AS n_rows, date_trunc('day', min(t)) AS first_date, date_trunc('day', max(t)) AS last_date, count(DISTINCT date_trunc('month', t)) AS n_months FROM points GROUP BY 1")
def _(f: Frames) -> DataFrame:
    return f.points.groupBy("type").agg(F.count(F.lit(1)).alias("n_rows"), F.to_date(F.min("t")).alias("first_date"), F.to_date(F.max("t")).alias("last_date"), F.count_distinct(month_of(F.col("t"))).alias("n_months"))


@register("monthly_category_counts", monthly_binding, "z AS (SELECT 1) SELECT date_trunc('month', t) AS month, type, count(*) AS n_rows FROM points GROUP BY 1, 2")
def _(f: Frames) -> DataFrame:
    return f.points.groupBy(month_of(F.col("t")).alias("month"), "type").agg(F.count(F.lit(1)).alias("n_rows"))


@register("period_top_categories", monthly_binding, "c AS (SELECT CASE WHEN t < TIMESTAMP '1996-06-01' THEN 'before' ELSE 'after' END AS period, organism_name AS label, count(*) AS n_rows FROM points GROUP BY 1, 2) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY period ORDER BY n_rows DESC, label) AS INTEGER) AS rank FROM c) WHERE rank <= 25")
def _(f: Frames) -> DataFrame:
    counts = f.points.groupBy(period_of(F.col("t"), "1996-06-01").alias("period"), F.col("organism_name").alias("label")).agg(F.count(F.lit(1)).alias("n_rows"))
    return cal.top_within(counts, "period", 25, F.desc("n_rows"), F.asc_nulls_last("label"))


@register("residual_names", monthly_binding, "z AS (SELECT 1) SELECT name, count(*) AS n_rows FROM points WHERE t >= TIMESTAMP '1996-06-01' AND type = '5-low' GROUP BY 1")
def _(f: Frames) -> DataFrame:
    return f.points.filter((period_of(F.col("t"), "1996-06-01") == "after") & (F.col("type") == "5-low")).groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"))


# Detections

LEVELS = {"group": "organism_group", "category": "organism_category", "name": "organism_name"}
_DETECTED = "count(*) AS n_rows, count(DISTINCT event_id) AS n_events, count(DISTINCT encounter) AS n_encounters, count(DISTINCT subject) AS n_subjects"
_CLASS = """CASE WHEN regexp_matches({x}, 'small|mini') THEN 'Small' WHEN regexp_matches({x}, 'standard|medium') THEN 'Standard'
  WHEN regexp_matches({x}, 'large|promo') THEN 'Large' ELSE 'Other/unspecified' END"""


def detected(df: DataFrame, *keys: str) -> DataFrame:
    """Detection rows, events, encounters and subjects by keys, with the class of the organism."""
    levels = {"n_subjects": ["subject"], "n_encounters": ["encounter"], "n_events": ["event_id"]}
    counts = nested_counts(df, list(keys), levels, {"n_rows": F.lit(1)})
    return counts.withColumn("class", classify(F.col("organism"), rules=CLASS_RULES))


def _detection_queries(level: str, column: str) -> None:
    @register(f"detections_overall_{level}", monthly_binding, f"z AS (SELECT 1) SELECT {column} AS organism, {_DETECTED}, {_CLASS.format(x=column)} AS class FROM detections GROUP BY 1")
    def _(f: Frames) -> DataFrame:
        return detected(f.detections.withColumn("organism", F.col(column)), "organism")

    @register(f"detections_by_type_{level}", monthly_binding, f"z AS (SELECT 1) SELECT type, {column} AS organism, {_DETECTED}, {_CLASS.format(x=column)} AS class FROM detections GROUP BY 1, 2")
    def _(f: Frames) -> DataFrame:
        return detected(f.detections.withColumn("organism", F.col(column)), "type", "organism")

    if level == "name":
        return
    top = f"top AS (SELECT {column} AS organism FROM (SELECT {column}, count(*) AS n FROM detections GROUP BY 1 ORDER BY n DESC, 1 LIMIT {TOP})), dm AS (SELECT min(month) AS lo, max(month) AS hi FROM detections), spine AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS month FROM dm), adm AS (SELECT month, count(*) AS n_episodes FROM episodes GROUP BY 1), d AS (SELECT *, {column} AS organism FROM detections WHERE {column} IN (SELECT organism FROM top)),\n"
    forms = {
        "": ([], "", "SELECT month, organism FROM spine, (SELECT DISTINCT organism FROM d)"),
        "_by_type": (["type"], "type,", "SELECT month, type, organism FROM spine, (SELECT DISTINCT type, organism FROM d)"),
        "_five_panel": (["panel"], "panel,", "SELECT month, panel, organism FROM spine, (SELECT unnest(['Overall', '1-urgent', '2-high', '3-medium', 'Other']) AS panel), top"),
    }
    for form, (extra, sql_keys, cells_sql) in forms.items():
        source = "(SELECT *, unnest(['Overall', CASE WHEN type IN ('1-urgent', '2-high', '3-medium') THEN type ELSE 'Other' END]) AS panel FROM d)" if extra == ["panel"] else "d"
        keys = ["month", *extra, "organism"]
        joined = f"""c AS (SELECT month, {sql_keys} organism, count(*) AS n_rows, count(DISTINCT event_id) AS n_events FROM {source} GROUP BY ALL), g AS ({cells_sql})
SELECT month, {sql_keys} organism, coalesce(n_rows, 0) AS n_rows, coalesce(n_events, 0) AS n_events, {_CLASS.format(x="organism")} AS class"""

        def counted(f: Frames, extra: list[str] = extra, keys: list[str] = keys) -> DataFrame:
            f.once("episodes")
            rows = f.once("detections").withColumn("organism", F.col(column))
            top_n = stored(cal.top_labels(rows, "organism", TOP))
            kept = cal.keep_top(rows, "organism", top_n)
            if extra == ["panel"]:
                kept = panels(kept)
            counts = stored(kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), n_distinct("event_id").alias("n_events")))
            if extra == ["panel"]:
                cells = cal.levels(rows, "panel", ["Overall", *PANELS, "Other"]).crossJoin(F.broadcast(top_n.select("organism")))
            else:
                cells = counts.select(*keys[1:]).distinct()
            out = cal.complete(counts, cal.grid(cal.month_spine(rows), cells), keys, {"n_rows": 0, "n_events": 0})
            return out.withColumn("class", classify(F.col("organism"), rules=CLASS_RULES))

        register(f"monthly_detections{form}_{level}", monthly_binding, top + joined + f" FROM g LEFT JOIN c USING ({', '.join(keys)})")(counted)

        def rated(f: Frames, counted: Callable = counted) -> DataFrame:
            out = counted(f).join(F.broadcast(episode_counts(f)), "month", "left")
            return per(out, "n_episodes", rows_per_100="n_rows", events_per_100="n_events").drop("n_episodes")

        register(
            f"detection_rates{form}_{level}",
            monthly_binding,
            top + joined + f""", {_rate("n_rows", "n_episodes")} AS rows_per_100, {_rate("n_events", "n_episodes")} AS events_per_100
FROM g LEFT JOIN c USING ({', '.join(keys)}) LEFT JOIN adm USING (month)""",
        )(rated)


for _level, _column in LEVELS.items():
    _detection_queries(_level, _column)


@register("top_by_type", monthly_binding, """c AS (SELECT type, organism_name AS organism, count(*) AS n_rows, count(DISTINCT event_id) AS n_events FROM detections GROUP BY 1, 2)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY type ORDER BY n_rows DESC, organism) AS INTEGER) AS rank FROM c) WHERE rank <= 5""")
def _(f: Frames) -> DataFrame:
    counts = f.detections.groupBy("type", F.col("organism_name").alias("organism")).agg(F.count(F.lit(1)).alias("n_rows"), n_distinct("event_id").alias("n_events"))
    return cal.top_within(counts, "type", TOP, F.desc("n_rows"), F.asc_nulls_last("organism"))


@register("top_trend_series", monthly_binding, f"""dm AS (SELECT min(month) AS lo, max(month) AS hi FROM detections), spine AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS month FROM dm),
adm AS (SELECT month, count(*) AS n_episodes FROM episodes GROUP BY 1),
top AS (SELECT organism_name AS organism, CAST(row_number() OVER (ORDER BY count(*) DESC, organism_name) AS INTEGER) AS level FROM detections GROUP BY 1 ORDER BY level LIMIT {TOP}),
c AS (SELECT month, organism_name AS organism, count(*) AS n_rows FROM detections GROUP BY 1, 2),
r AS (SELECT month, organism, level, CASE WHEN n_episodes > 0 THEN 100.0 * coalesce(n_rows, 0) / n_episodes END AS rate FROM spine CROSS JOIN top LEFT JOIN c USING (month, organism) LEFT JOIN adm USING (month))
SELECT month, organism, level, round(rate, 6) AS rows_per_100, round(CASE WHEN count(rate) OVER w = 6 THEN avg(rate) OVER w END, 6) AS trailing
FROM r WINDOW w AS (PARTITION BY organism ORDER BY month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def _(f: Frames) -> DataFrame:
    """The most detected labels: rows per 100 episodes of each month and their trailing mean over six months."""
    f.once("episodes")
    counts = stored(f.detections.groupBy("month", F.col("organism_name").alias("organism")).agg(F.count(F.lit(1)).alias("n_rows")))
    totals = counts.groupBy("organism").agg(F.sum("n_rows").alias("total")).orderBy(F.desc("total"), F.asc_nulls_last("organism")).limit(TOP)
    top = totals.select("organism", F.row_number().over(Window.orderBy(F.desc("total"), F.asc_nulls_last("organism"))).alias("level"))
    rows = cal.complete(cal.keep_top(counts, "organism", top), cal.grid(cal.month_spine(counts), top.select("organism")), ["month", "organism"], {"n_rows": 0})
    rows = rows.join(F.broadcast(top), "organism").join(F.broadcast(episode_counts(f)), "month", "left").withColumn("rate", rate_per(F.col("n_rows"), F.col("n_episodes")))
    rows = rows.withColumn("trailing", cal.trailing_mean("rate", ["organism"], "month"))
    return rows.select("month", "organism", "level", F.round("rate", 6).alias("rows_per_100"), F.round("trailing", 6).alias("trailing"))


@register("classify_taxonomy", monthly_binding, "z AS (SELECT DISTINCT organism_name AS code FROM points) SELECT code, CASE WHEN regexp_matches(code, 'small|mini') THEN 'Small' WHEN regexp_matches(code, 'standard|medium') THEN 'Standard' WHEN regexp_matches(code, 'large|promo') THEN 'Large' ELSE 'Other/unspecified' END AS class, CASE WHEN regexp_matches(code, 'gram|cocci|bacilli|rods|flora') THEN 'Other bacteria' ELSE 'Other/unspecified' END AS label_class FROM z")
def _(f: Frames) -> DataFrame:
    return f.points.select(F.col("organism_name").alias("code")).distinct().select("code", classify(F.col("code"), rules=CLASS_RULES).alias("class"), classify(F.col("code"), "regex_label").alias("label_class"))


@register("pattern_groups", monthly_binding, "z AS (SELECT 1) SELECT CASE WHEN contains(organism_name, 'ring') THEN 'Ring' WHEN contains(organism_name, 'bolt') THEN 'Bolt' END AS part_group, count(*) AS n_rows FROM points GROUP BY 1")
def _(f: Frames) -> DataFrame:
    return f.points.groupBy(pattern_group(F.col("organism_name"), [("ring", "Ring"), ("bolt", "Bolt")]).alias("part_group")).agg(F.count(F.lit(1)).alias("n_rows"))


@register("excluded_negative_names", monthly_binding, "z AS (SELECT 1) SELECT count(*) FILTER (WHERE positive AND regexp_matches(lower(organism_name), '^(no|none|not) .*isolated|no growth|no .* detected|negative for')) AS n_excluded FROM attached")
def _(f: Frames) -> DataFrame:
    return f.attached.agg(F.count_if(F.col("positive") & negative_name(F.col("organism_name"))).alias("n_excluded"))


# Timing; on the hourly binding

_LOS = "ep AS (SELECT *, date_diff('microsecond', t_in, t_out) / 8.64e10 AS los FROM episodes),\n"
_FIRST = "fe AS (SELECT encounter, seq, first_t, first_type, hours FROM (SELECT encounter, seq, t AS first_t, type AS first_type, hours, row_number() OVER (PARTITION BY encounter, seq ORDER BY t, type) AS k FROM events_) WHERE k = 1),\n"
_BIN = "CASE WHEN hours IS NULL THEN 'No ICU culture' WHEN hours < 6 THEN '0-6 hours' WHEN hours < 24 THEN '6-24 hours' WHEN hours < 48 THEN 'ICU day 2' WHEN hours < 72 THEN 'ICU day 3' WHEN hours < 168 THEN 'ICU days 4-7' ELSE 'After ICU day 7' END"
_TIMING = _LOS + _FIRST + f"tm AS (SELECT e.encounter, e.seq, first_t, coalesce(first_type, 'No ICU culture') AS first_type, hours, first_t IS NOT NULL AS any_event, CAST(floor(hours / 24) AS BIGINT) + 1 AS first_day, {_BIN} AS bin FROM episodes e LEFT JOIN fe USING (encounter, seq)),\n"


def first_event(f: Frames) -> DataFrame:
    """The first event of each episode; ties by type."""
    first = F.min(F.struct("t", "type", "hours")).alias("first")
    return f.events.groupBy("encounter", "seq").agg(first).select("encounter", "seq", F.col("first.t").alias("first_t"), F.col("first.type").alias("first_type"), F.col("first.hours").alias("hours"))


def timing(f: Frames) -> DataFrame:
    """Every episode with its first event, day and bin."""
    out = f.once("episodes").select("encounter", "seq").join(first_event(f), ["encounter", "seq"], "left")
    label, order = timing_bin(F.col("hours"))
    return out.withColumns({"first_type": F.coalesce("first_type", F.lit("No ICU culture")), "any_event": F.col("first_t").isNotNull(), "first_day": (F.floor(F.col("hours") / 24) + 1).cast("bigint"), "bin": label, "bin_order": order})


@register("first_event", hourly_binding, _FIRST + "z AS (SELECT 1) SELECT encounter, seq, first_t, first_type, round(hours, 6) AS hours FROM fe")
def _(f: Frames) -> DataFrame:
    return first_event(f).withColumn("hours", F.round("hours", 6))


@register("first_event_timing", hourly_binding, _TIMING + "z AS (SELECT 1) SELECT encounter, seq, first_t, first_type, any_event, first_day, bin FROM tm")
def _(f: Frames) -> DataFrame:
    return timing(f).drop("hours", "bin_order")


@register("timing_bins", hourly_binding, _TIMING + "z AS (SELECT 1) SELECT bin, first_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM tm GROUP BY 1, 2")
def _(f: Frames) -> DataFrame:
    counts, total = timing(f).groupBy("bin", "first_type").agg(F.count(F.lit(1)).alias("n")), f.once("episodes").agg(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("bin", "first_type", "n", F.round(rate_per(F.col("n"), F.col("total")), 6).alias("percent"))


@register("timing_bins_top", hourly_binding, _TIMING + "top AS (SELECT first_type FROM (SELECT first_type, count(*) AS n FROM tm GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3)) SELECT bin, CASE WHEN first_type IN (SELECT first_type FROM top) THEN first_type ELSE 'Other' END AS first_type, count(*) AS n FROM tm GROUP BY 1, 2")
def _(f: Frames) -> DataFrame:
    rows = stored(timing(f).select("bin", "first_type"))
    return cal.lump(rows, "first_type", cal.top_labels(rows, "first_type", 3)).groupBy("bin", "first_type").agg(F.count(F.lit(1)).alias("n"))


@register("timing_summary", hourly_binding, _TIMING + "z AS (SELECT 1) SELECT count(*) AS n, count(*) FILTER (WHERE any_event) AS n_with, round(100.0 * count(*) FILTER (WHERE any_event) / count(*), 6) AS percent_with, round(quantile_cont(hours, 0.5), 6) AS median_hours, round(quantile_cont(hours, 0.25), 6) AS p25_hours, round(quantile_cont(hours, 0.75), 6) AS p75_hours FROM tm")
def _(f: Frames) -> DataFrame:
    rows = stored(timing(f).select("any_event", "hours"))
    spread = quantiles(rows, "hours", {"median_hours": 0.5, "p25_hours": 0.25, "p75_hours": 0.75})
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("any_event").alias("n_with")).crossJoin(spread)
    return per(out, "n", percent_with="n_with").withColumns({c: F.round(c, 6) for c in spread.columns})


@register("day_event_rates", hourly_binding, _LOS + f"g AS (SELECT CAST(unnest(generate_series(1, {DAYS})) AS INTEGER) AS day), r AS (SELECT g.day, count(*) FILTER (WHERE los > g.day - 1) AS n_at_risk FROM ep, g GROUP BY 1), c AS (SELECT day, count(*) AS n_events FROM events_ GROUP BY 1) SELECT day, coalesce(n_events, 0) AS n_events, n_at_risk, round(CASE WHEN n_at_risk > 0 THEN 100.0 * coalesce(n_events, 0) / n_at_risk END, 6) AS events_per_100 FROM r LEFT JOIN c USING (day)")
def _(f: Frames) -> DataFrame:
    days = f.episodes.sparkSession.range(1, DAYS + 1).select(F.col("id").cast("int").alias("day"))
    risk = at_risk(f.once("episodes").withColumn("los_days", days_between(F.col("t_in"), F.col("t_out"))), DAYS)
    counts = f.events.groupBy(F.col("day").cast("int").alias("day")).agg(F.count(F.lit(1)).alias("n_events"))
    out = days.join(counts, "day", "left").join(risk, "day", "left").select("day", F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce("n_at_risk", F.lit(0)).alias("n_at_risk"))
    return out.withColumn("events_per_100", F.round(rate_per(F.col("n_events"), F.col("n_at_risk")), 6))


@register("cumulative_first_by_day", hourly_binding, _TIMING + f"g AS (SELECT CAST(unnest(generate_series(1, {DAYS})) AS INTEGER) AS day) SELECT g.day, count(*) FILTER (WHERE first_day <= g.day) AS n_by_day, round(100.0 * count(*) FILTER (WHERE first_day <= g.day) / count(*), 6) AS percent_by_day FROM tm, g GROUP BY 1")
def _(f: Frames) -> DataFrame:
    days = f.episodes.sparkSession.range(1, DAYS + 1).select(F.col("id").cast("int").alias("day"))
    counts = timing(f).filter("first_day IS NOT NULL").groupBy(F.col("first_day").cast("int").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    out = days.join(counts, "day", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("n_by_day", cal.running_sum("n", [], "day"))
    return out.crossJoin(F.broadcast(f.once("episodes").agg(F.count(F.lit(1)).alias("total")))).select("day", "n_by_day", F.round(rate_per(F.col("n_by_day"), F.col("total")), 6).alias("percent_by_day"))


def by_hour(counts: DataFrame, label: str) -> DataFrame:
    """n by label and hour, completed to hours 0 to HOURS, with the running sum n_by_hour."""
    hours = counts.sparkSession.range(0, HOURS + 1).select(F.col("id").cast("int").alias("hour"))
    cells = counts.select(label).distinct().crossJoin(F.broadcast(hours))
    out = cells.join(counts, [label, "hour"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("n_by_hour", cal.running_sum("n", [label], "hour"))


@register("cumulative_events_by_hour", hourly_binding, f"h AS (SELECT CAST(unnest(generate_series(0, {HOURS})) AS INTEGER) AS hour), x AS (SELECT type, ceil(hours) AS hour FROM events_), t AS (SELECT count(*) AS total FROM events_) SELECT type, h.hour, count(*) FILTER (WHERE x.hour <= h.hour) AS n_by_hour, round(100.0 * count(*) FILTER (WHERE x.hour <= h.hour) / any_value(total), 6) AS percent FROM x, h, t GROUP BY 1, 2")
def _(f: Frames) -> DataFrame:
    counts = stored(f.events.groupBy("type", F.ceil("hours").cast("int").alias("hour")).agg(F.count(F.lit(1)).alias("n")))
    out = by_hour(counts, "type").crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"))))
    return out.select("type", "hour", "n_by_hour", F.round(rate_per(F.col("n_by_hour"), F.col("total")), 6).alias("percent"))


@register("distinct_detections", hourly_binding, "z AS (SELECT 1) SELECT DISTINCT encounter, seq, t, type, organism_name AS organism FROM detections")
def _(f: Frames) -> DataFrame:
    return f.detections.select("encounter", "seq", "t", "type", F.col("organism_name").alias("organism")).distinct()


def first_detection(f: Frames) -> DataFrame:
    return f.detections.groupBy("encounter", "seq", F.col("organism_name").alias("organism")).agg(F.min("hours").alias("hours"))


@register("first_detection", hourly_binding, "z AS (SELECT 1) SELECT encounter, seq, organism_name AS organism, round(min(hours), 6) AS hours FROM detections GROUP BY 1, 2, 3")
def _(f: Frames) -> DataFrame:
    return first_detection(f).withColumn("hours", F.round("hours", 6))


@register("cumulative_incidence", hourly_binding, f"fd AS (SELECT encounter, seq, organism_name AS organism, ceil(min(hours)) AS hour FROM detections GROUP BY 1, 2, 3), h AS (SELECT CAST(unnest(generate_series(0, {HOURS})) AS INTEGER) AS hour), t AS (SELECT count(*) AS total FROM episodes) SELECT organism, h.hour, count(*) FILTER (WHERE fd.hour <= h.hour) AS n_by_hour, round(100.0 * count(*) FILTER (WHERE fd.hour <= h.hour) / any_value(total), 6) AS per_100_episodes FROM fd, h, t GROUP BY 1, 2")
def _(f: Frames) -> DataFrame:
    f.once("episodes")
    counts = stored(first_detection(f).groupBy("organism", F.ceil("hours").cast("int").alias("hour")).agg(F.count(F.lit(1)).alias("n")))
    out = by_hour(counts, "organism").crossJoin(F.broadcast(f.once("episodes").agg(F.count(F.lit(1)).alias("total"))))
    return out.select("organism", "hour", "n_by_hour", F.round(rate_per(F.col("n_by_hour"), F.col("total")), 6).alias("per_100_episodes"))


# Targets, phenotypes, trends

_TEXT = "organism_name || ' ' || organism_category || ' ' || organism_group"
_TAGS = f"tagged AS (SELECT DISTINCT event_id, month, target_label FROM (SELECT event_id, month, unnest([CASE WHEN regexp_matches(x, '\\bring\\b') THEN 'Ring' END, CASE WHEN regexp_matches(x, 'bolt') THEN 'Bolt' END, CASE WHEN regexp_matches(x, 'screw') THEN 'Screw' END, CASE WHEN regexp_matches(x, 'steel|brass|copper|tin|nickel') THEN 'Metal' END]) AS target_label FROM (SELECT *, {_TEXT} AS x FROM detections)) WHERE target_label IS NOT NULL),\n"
_PHENO = "sus AS (SELECT DISTINCT organism_id, drug FROM points WHERE sir = 'R'), pheno AS (SELECT DISTINCT event_id, month, CASE WHEN regexp_matches(organism_name, 'bolt|ring') AND regexp_matches(s.drug, 'brand#1') THEN 'R1' WHEN regexp_matches(organism_name, 'screw|nut') AND regexp_matches(s.drug, 'brand#2') THEN 'R2' WHEN regexp_matches(s.drug, 'brand#3') THEN 'R3' END AS target_label FROM detections d JOIN sus s USING (organism_id)),\n"
_BOTH = _TAGS + _PHENO + "tt AS (SELECT event_id, month, CASE target_label WHEN 'Ring' THEN 'R1' WHEN 'Screw' THEN 'R2' ELSE target_label END AS target_label, 'text' AS source FROM tagged), comb AS (SELECT target_label, event_id, month, CASE WHEN min(CASE source WHEN 'susceptibility' THEN 0 ELSE 1 END) = 0 THEN 'susceptibility' ELSE 'text' END AS source FROM (SELECT event_id, month, target_label, source FROM tt UNION ALL SELECT event_id, month, target_label, 'susceptibility' FROM pheno WHERE target_label IS NOT NULL) GROUP BY 1, 2, 3),\n"


def tags(f: Frames) -> DataFrame:
    """event_id, month and every target whose pattern the names match; an event comes once a row of it."""
    text = F.concat_ws(" ", "organism_name", "organism_category", "organism_group")
    return tag_targets(f.frame("detections"), text, TARGETS).select("event_id", "month", "target_label")


def resistances(f: Frames) -> DataFrame:
    """event_id, month and phenotype of detections whose organism has a resistant result; organism and drug patterns name the phenotype."""
    resistant = f.points.filter((norm_sir(F.col("sir")) == "resistant") & F.col("organism_id").isNotNull() & (F.col("organism_id") != "")).select("organism_id", F.col("drug").alias("tested")).distinct()
    rows = f.frame("detections").join(resistant, "organism_id")
    return rows.select("event_id", "month", phenotype(F.col("organism_name"), F.col("tested"), PHENOTYPES).alias("target_label")).filter("target_label IS NOT NULL")


def tagged(f: Frames) -> DataFrame:
    return tags(f).distinct()


def phenotypes(f: Frames) -> DataFrame:
    return resistances(f).distinct()


def combined(f: Frames) -> DataFrame:
    """Targets by text and by susceptibility, the latter preferred for the same target, event and month; one row each, by one grouping."""
    f.once("detections")
    label = F.when(F.col("target_label") == "Ring", "R1").when(F.col("target_label") == "Screw", "R2").otherwise(F.col("target_label"))
    text = tags(f).withColumns({"target_label": label, "rank": F.lit(1)})
    both = text.unionByName(resistances(f).withColumn("rank", F.lit(0)))
    ranked = both.groupBy("target_label", "event_id", "month").agg(F.min("rank").alias("rank"))
    return ranked.select("target_label", "event_id", "month", F.when(F.col("rank") == 0, "susceptibility").otherwise("text").alias("source"))


_EVENT = "split_part(event_id, '|', 1) AS encounter, split_part(event_id, '|', 2) AS seq, split_part(event_id, '|', 4) AS type"


def unpacked(df: DataFrame) -> DataFrame:
    part = F.split("event_id", r"\|")
    return df.withColumns({"encounter": part[0], "seq": part[1], "type": part[3]}).drop("event_id")


@register("tag_targets", monthly_binding, _TAGS + f"z AS (SELECT 1) SELECT {_EVENT}, month, target_label FROM tagged")
def _(f: Frames) -> DataFrame:
    return unpacked(tagged(f))


@register("phenotypes", monthly_binding, _PHENO + f"z AS (SELECT 1) SELECT {_EVENT}, month, target_label FROM pheno WHERE target_label IS NOT NULL")
def _(f: Frames) -> DataFrame:
    return unpacked(phenotypes(f))


@register("combine_targets", monthly_binding, _BOTH + f"z AS (SELECT 1) SELECT {_EVENT}, month, target_label, source FROM comb")
def _(f: Frames) -> DataFrame:
    return unpacked(combined(f))


@register("target_source_summary", monthly_binding, _BOTH + "g AS (SELECT target_label, source FROM (SELECT DISTINCT target_label FROM comb), (SELECT unnest(['text', 'susceptibility']) AS source)), c AS (SELECT target_label, source, count(*) AS n FROM comb GROUP BY 1, 2) SELECT target_label, source, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (target_label, source)")
def _(f: Frames) -> DataFrame:
    counts = stored(combined(f).groupBy("target_label", "source").agg(F.count(F.lit(1)).alias("n")))
    cells = counts.select("target_label").distinct().crossJoin(F.broadcast(cal.levels(counts, "source", ["text", "susceptibility"])))
    return cal.complete(counts, cells, ["target_label", "source"], {"n": 0})


def label_counts(f: Frames) -> DataFrame:
    """month, label, detection rows and events of every detected name; one pass, stored."""
    f.once("episodes")
    return stored(f.detections.groupBy("month", F.col("organism_name").alias("label")).agg(F.count(F.lit(1)).alias("n_rows"), n_distinct("event_id").alias("n_events")))


def target_counts(f: Frames) -> DataFrame:
    """month, label and events of every target, stored."""
    f.once("episodes")
    # Combined rows are distinct, so events of a month and label are its rows.
    return stored(combined(f).groupBy("month", F.col("target_label").alias("label")).agg(F.count(F.lit(1)).alias("n_events")))


def monthly_rates(f: Frames, counts: DataFrame, months: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """label, month, n_events on a full calendar from the first to the last of `months`, with both denominators and both rates.

    counts: month, label, n_events. With given labels each of them has a series, of zeros where nothing was detected.
    """
    cells = cal.grid(cal.month_spine(months), counts.select("label").distinct() if labels is None else labels)
    out = cal.complete(counts.select("month", "label", "n_events"), cells, ["month", "label"], {"n_events": 0})
    out = out.join(F.broadcast(denominators(f)), "month", "left")
    return stored(out.withColumns({"per_100_episodes": rate_per(F.col("n_events"), F.col("n_episodes")), "per_100_days": rate_per(F.col("n_events"), F.col("n_days"))}))


def all_rates(f: Frames) -> DataFrame:
    counts = label_counts(f)
    return monthly_rates(f, counts, counts)


def top_rates(f: Frames) -> DataFrame:
    """The series of the labels with the most detection rows."""
    counts = label_counts(f)
    totals = counts.groupBy("label").agg(F.sum("n_rows").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("label")).limit(TOP)
    return monthly_rates(f, cal.keep_top(counts, "label", totals), counts)


def target_rates(f: Frames) -> DataFrame:
    counts = target_counts(f)
    return monthly_rates(f, counts, f.once("detections"))


_RATE_SQL = """dm AS (SELECT min(month) AS lo, max(month) AS hi FROM detections), spine AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS month FROM dm),
den AS (SELECT month, coalesce(n_episodes, 0) AS n_episodes, coalesce(n_days, 0) AS n_days FROM exposure FULL JOIN clipadm USING (month)),
c AS (SELECT month, label, count(DISTINCT event_id) AS n_events FROM lab GROUP BY 1, 2),
rates AS (SELECT month, label, coalesce(n_events, 0) AS n_events, n_episodes, n_days,
  CASE WHEN n_episodes > 0 THEN 100.0 * coalesce(n_events, 0) / n_episodes END AS per_100_episodes, CASE WHEN n_days > 0 THEN 100.0 * coalesce(n_events, 0) / n_days END AS per_100_days
  FROM (SELECT month, label FROM spine, (SELECT DISTINCT label FROM c)) LEFT JOIN c USING (month, label) LEFT JOIN den USING (month))"""
_ALL_LAB = "lab AS (SELECT *, organism_name AS label FROM detections),\n"
_TOP_LAB = f"""lab AS (SELECT *, organism_name AS label FROM detections WHERE organism_name IN (
  SELECT organism_name FROM (SELECT organism_name, count(*) AS n FROM detections GROUP BY 1 ORDER BY n DESC, 1 LIMIT {TOP}))),\n"""
_TARGET_LAB = _BOTH + "lab AS (SELECT *, target_label AS label FROM comb),\n"
_RATE_OUT = " SELECT month, label, n_events, round(per_100_episodes, 6) AS per_100_episodes, round(per_100_days, 6) AS per_100_days FROM rates"


def fit_sql(exposure: str) -> str:
    """CTEs that fit each label of rates by 25 Newton steps: fit (label, a, b), screen (the trend's measures)."""
    mu = "x.e * exp(a + b * x.t)"
    sums = ", ".join(f"list_sum(list_transform(series, lambda x: {term})) AS {name}" for name, term in (("g0", f"x.y - {mu}"), ("g1", f"x.t * (x.y - {mu})"), ("h00", mu), ("h01", f"x.t * {mu}"), ("h11", f"x.t * x.t * {mu}")))
    erf = "exp(-w * w + k * ln(2) + (2 * k + 1) * ln(w) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()))"
    return f""", kept AS (SELECT label, month, CAST(n_events AS DOUBLE) AS y, CAST({exposure} AS DOUBLE) AS e, date_diff('day', min(month) OVER (PARTITION BY label), month) / 30.4375 AS t FROM rates WHERE {exposure} > 0),
ser AS (SELECT label, list(struct_pack(t := t, y := y, e := e) ORDER BY month) AS series, sum(y) AS total, sum(e) AS exposed FROM kept GROUP BY 1 HAVING count(*) >= 12 AND sum(y) > 0),
fit AS (WITH RECURSIVE step AS (SELECT label, series, ln(total / exposed) AS a, 0.0::DOUBLE AS b, 0 AS i FROM ser
  UNION ALL SELECT label, series, a + coalesce((h11 * g0 - h01 * g1) / nullif(h00 * h11 - h01 * h01, 0), 0), b + coalesce((h00 * g1 - h01 * g0) / nullif(h00 * h11 - h01 * h01, 0), 0), i + 1
  FROM (SELECT *, {sums} FROM step WHERE i < 25)) SELECT label, series, a, b FROM step WHERE i = 25),
wald AS (SELECT label, b, abs(b / sqrt(h00 / nullif(h00 * h11 - h01 * h01, 0))) / sqrt(2) AS w FROM (SELECT *, {sums} FROM fit)),
tail AS (SELECT label, b, CASE WHEN w = 0 THEN 1.0 WHEN w > 6 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(generate_series(0, 150), lambda k: {erf})) END AS p_value FROM wald),
facts AS (SELECT label, CAST(sum(n_events) AS BIGINT) AS total, min(month) FILTER (WHERE n_events > 0) AS first_month, max(month) FILTER (WHERE n_events > 0) AS last_month,
  avg(CASE WHEN {exposure} > 0 THEN 100.0 * n_events / {exposure} END) AS mean_rate, max(CASE WHEN {exposure} > 0 THEN 100.0 * n_events / {exposure} END) AS max_rate FROM rates GROUP BY 1),
screen AS (SELECT label, total, first_month, last_month, mean_rate, max_rate, exp(b) AS monthly_ratio, exp(12 * b) AS annual_ratio, 100 * (exp(12 * b) - 1) AS annual_percent_change, p_value,
  CASE WHEN total = 0 THEN 'Not observed' WHEN b IS NULL THEN 'Not estimated' WHEN p_value < 0.05 AND b > 0 THEN 'Increasing' WHEN p_value < 0.05 AND b < 0 THEN 'Decreasing' ELSE 'No clear trend' END AS direction FROM facts LEFT JOIN tail USING (label))"""


_MEASURED = ["mean_rate", "max_rate", "monthly_ratio", "annual_ratio", "annual_percent_change", "p_value"]
_SCREEN_OUT = "label, total, first_month, last_month, direction, " + ", ".join(f"round({m}, 6) AS {m}" for m in _MEASURED)


def screened(df: DataFrame) -> DataFrame:
    return df.select("label", "total", "first_month", "last_month", "direction", *[F.round(m, 6).alias(m) for m in _MEASURED])


def rounded(df: DataFrame) -> DataFrame:
    return df.select("month", "label", "n_events", F.round("per_100_episodes", 6).alias("per_100_episodes"), F.round("per_100_days", 6).alias("per_100_days"))


for _set, _rates, _lab in (("top", top_rates, _TOP_LAB), ("target", target_rates, _TARGET_LAB)):
    register(f"detection_monthly_rates_{_set}", monthly_binding, _CLIPPED + _lab + _RATE_SQL + _RATE_OUT)(lambda f, rates=_rates: rounded(rates(f)))
    for _unit, _exposure in (("episodes", "n_episodes"), ("days", "n_days")):
        register(f"trend_screen_{_set}_{_unit}", monthly_binding, _CLIPPED + _lab + _RATE_SQL + fit_sql(_exposure) + f" SELECT {_SCREEN_OUT} FROM screen")(
            lambda f, rates=_rates, e=_exposure: screened(trend_screen(rates(f), "label", "n_events", e))
        )


@register("empty_target_grid", monthly_binding, _CLIPPED + """lab AS (SELECT event_id, month, 'a' AS label FROM detections WHERE false), named AS (SELECT unnest(['Absent', 'Lacking']) AS label),
""" + _RATE_SQL + """ SELECT month, label, 0::BIGINT AS n_events, CASE WHEN n_episodes > 0 THEN 0::DOUBLE END AS per_100_episodes, CASE WHEN n_days > 0 THEN 0::DOUBLE END AS per_100_days
FROM spine CROSS JOIN named LEFT JOIN den USING (month)""")
def _(f: Frames) -> DataFrame:
    """Targets that no detection names still have their series, of zeros."""
    f.once("episodes")
    absent = [("Absent", "no such name"), ("Lacking", "nor this one")]
    rows = tag_targets(f.once("detections"), F.col("organism_name"), absent)
    counts = rows.groupBy("month", F.col("target_label").alias("label")).agg(n_distinct("event_id").alias("n_events"))
    return rounded(monthly_rates(f, counts, f.once("detections"), cal.levels(rows, "label", [label for label, _ in absent])))


@register("trailing_mean", monthly_binding, _CLIPPED + _TOP_LAB + _RATE_SQL + """ SELECT month, label, round(per_100_episodes, 6) AS rate,
  round(CASE WHEN count(per_100_episodes) OVER w = 6 THEN avg(per_100_episodes) OVER w END, 6) AS trailing
FROM rates WINDOW w AS (PARTITION BY label ORDER BY month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def _(f: Frames) -> DataFrame:
    out = top_rates(f).withColumn("trailing", cal.trailing_mean("per_100_episodes", ["label"], "month"))
    return out.select("month", "label", F.round("per_100_episodes", 6).alias("rate"), F.round("trailing", 6).alias("trailing"))


def observed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("label").agg(F.sum("n_events").alias("total")).filter("total > 0")


@register("observed_targets", monthly_binding, _CLIPPED + _TARGET_LAB + _RATE_SQL + " SELECT label, CAST(sum(n_events) AS BIGINT) AS total FROM rates GROUP BY 1 HAVING sum(n_events) > 0")
def _(f: Frames) -> DataFrame:
    return observed(target_counts(f))


def movers(rates: DataFrame, rising: bool, n: int = 5, least: int = 25) -> DataFrame:
    """The n labels of at least `least` events whose rate rises (falls) fastest."""
    change = F.col("annual_percent_change")
    screen = trend_screen(rates, "label", "n_events", "n_episodes").filter((F.col("total") >= least) & change.isNotNull())
    return screen.orderBy(change.desc() if rising else change.asc(), "label").limit(n)


_MOVERS = """, risers AS (SELECT * FROM screen WHERE total >= 25 AND annual_percent_change IS NOT NULL ORDER BY annual_percent_change DESC, label LIMIT 5),
fallers AS (SELECT * FROM screen WHERE total >= 25 AND annual_percent_change IS NOT NULL ORDER BY annual_percent_change, label LIMIT 5)"""
for _name, _rising in (("risers", True), ("fallers", False)):
    register(f"fastest_{_name}", monthly_binding, _CLIPPED + _ALL_LAB + _RATE_SQL + fit_sql("n_episodes") + _MOVERS + f" SELECT {_SCREEN_OUT} FROM {_name}")(
        lambda f, rising=_rising: screened(movers(all_rates(f), rising))
    )
_SERIES = """month, label, part, n_events, round(per_100_episodes, 6) AS per_100_episodes, round(per_100_days, 6) AS per_100_days,
  round(CASE WHEN count(per_100_episodes) OVER w = 6 THEN avg(per_100_episodes) OVER w END, 6) AS trailing_episodes,
  round(CASE WHEN count(per_100_days) OVER w = 6 THEN avg(per_100_days) OVER w END, 6) AS trailing_days"""
_WINDOW = " WINDOW w AS (PARTITION BY part, label ORDER BY month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"


def with_trailing(df: DataFrame) -> DataFrame:
    rates = {"per_100_episodes": "trailing_episodes", "per_100_days": "trailing_days"}
    means = {new: cal.trailing_mean(rate, ["part", "label"], "month") for rate, new in rates.items()}
    return df.withColumns(means).select("month", "label", "part", "n_events", *[F.round(c, 6).alias(c) for c in (*rates, *rates.values())])


@register("selected_series", monthly_binding, _CLIPPED + _ALL_LAB + _RATE_SQL + fit_sql("n_episodes") + _MOVERS + f""",
chosen AS (SELECT label, 'riser' AS part FROM risers UNION ALL SELECT label, 'faller' FROM fallers) SELECT {_SERIES} FROM rates JOIN chosen USING (label)""" + _WINDOW)
def _(f: Frames) -> DataFrame:
    """The series of the fastest risers and fallers with both rates and their trailing means."""
    rates = all_rates(f)
    chosen = stored(movers(rates, True).select("label", F.lit("riser").alias("part")).unionByName(movers(rates, False).select("label", F.lit("faller").alias("part"))))
    return with_trailing(rates.join(F.broadcast(chosen), "label"))


@register("selected_target_series", monthly_binding, _CLIPPED + _TARGET_LAB + _RATE_SQL + f", chosen AS (SELECT label, 'target' AS part FROM rates GROUP BY 1 HAVING sum(n_events) > 0) SELECT {_SERIES} FROM rates JOIN chosen USING (label)" + _WINDOW)
def _(f: Frames) -> DataFrame:
    """The series of the observed targets."""
    rates = target_rates(f)
    return with_trailing(rates.join(F.broadcast(observed(rates).select("label", F.lit("target").alias("part"))), "label"))
