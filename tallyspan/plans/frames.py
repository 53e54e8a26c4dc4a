"""The canonical frames of the two table bindings, and the SQL prefixes that define the same frames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import any_true, composite_id, hours_between, month_of, negative_name, norm_text, of_method, positive_flag, stay_day
from ..functions.taxonomy import CLASS_CODES
from ..operators.intervals import attach_points, fill_open_end, merge_intervals
from ..sources.store import stored

EVENT_KEY = ["subject", "encounter", "seq", "t_in", "t_out", "t", "type", "name", "method"]
STUDY = ("1995-03-01", "1997-10-31")


@dataclass
class Frames:
    """Lazy frames of one binding; each property is a plan. Queries that need one more than once take it from `once`."""

    encounters: DataFrame
    stays: DataFrame
    points: DataFrame
    held: dict[str, DataFrame] = field(default_factory=dict)

    def once(self, name: str) -> DataFrame:
        """The frame of that name, computed once for this query and read from the shared folder from then on."""
        if name not in self.held:
            self.held[name] = stored(getattr(self, name))
        return self.held[name]

    def frame(self, name: str) -> DataFrame:
        """The stored frame if this query has one, else its plan."""
        return self.held[name] if name in self.held else getattr(self, name)

    @property
    def episodes(self) -> DataFrame:
        return merge_intervals(self.stays).withColumn("month", month_of(F.col("t_in")))

    @property
    def attached(self) -> DataFrame:
        return attach_points(self.points, self.frame("episodes").select("subject", "encounter", "seq", "t_in", "t_out"))

    @property
    def attached_stays(self) -> DataFrame:
        return attach_points(self.points, self.stays.select("subject", "encounter", "t_in", "t_out"))

    @property
    def events(self) -> DataFrame:
        """Point rows collapsed on the full key, with month, hours since admission and stay day."""
        groups = F.array_join(F.array_sort(F.collect_set("organism_group")), "; ")
        rows = self.frame("attached").groupBy(*EVENT_KEY).agg(F.count(F.lit(1)).alias("n_rows"), any_true(F.col("positive")).alias("any_positive"), groups.alias("organism_groups"))
        hours = hours_between(F.col("t_in"), F.col("t"))
        return rows.withColumns({"month": month_of(F.col("t")), "hours": hours, "day": stay_day(hours)})

    @property
    def detections(self) -> DataFrame:
        """Positive attached rows without explicit negatives, with their event id."""
        rows = self.frame("attached").filter(F.col("positive") & ~negative_name(F.col("organism_name")))
        rows = rows.drop("t_out", "method", "drug", "sir")
        return rows.withColumns({"event_id": composite_id(*[F.col(c) for c in ("encounter", "seq", "t", "type", "name")]), "month": month_of(F.col("t")), "hours": hours_between(F.col("t_in"), F.col("t"))})


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def monthly_binding(spark: SparkSession, d: str, named: Callable[[DataFrame], DataFrame] = lambda organisms: organisms) -> Frames:
    """Customers as encounters, groups of them as subjects, returned lines as stays, all lines as point rows; spans months.

    Texts are cleaned once an order and once a part, before these meet the lines; `named` may replace columns of the parts.
    """
    orders, lines = _read(spark, d, "orders"), _read(spark, d, "lineitem")
    key = F.col("o_custkey").cast("string")
    subject = (F.col("encounter").cast("bigint") % 500).cast("string")
    encounters = orders.groupBy(key.alias("encounter")).agg(F.min("o_orderdate").alias("admit"), (F.max("o_orderdate") + F.expr("interval 30 days")).alias("discharge"))
    encounters = encounters.withColumn("subject", subject)
    asked = orders.select("o_orderkey", key.alias("encounter"), F.col("o_orderdate").alias("t"), norm_text(F.col("o_orderpriority")).alias("type"), norm_text(F.col("o_orderstatus")).alias("name"), F.when(F.col("o_orderstatus") == "P", "stain").otherwise("culture").alias("method"))
    own = lines.join(asked.withColumn("subject", subject), lines["l_orderkey"] == asked["o_orderkey"])
    out = F.when((F.col("l_linenumber") == 1) & (F.col("l_linestatus") == "O"), None).otherwise(F.col("l_shipdate") + F.make_dt_interval(F.col("l_quantity").cast("int")))
    stays = own.filter(F.col("l_returnflag") == "R").select("encounter", F.col("l_shipdate").alias("t_in"), out.alias("t_out"))
    stays = fill_open_end(stays.join(encounters, "encounter"))
    kind = norm_text(F.col("p_type"))
    group = F.when(F.col("p_type") == "ECONOMY", "no_growth").otherwise(kind)
    organisms = _read(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("organism_id"), norm_text(F.col("p_name")).alias("organism_name"), kind.alias("organism_category"), group.alias("organism_group"), norm_text(F.col("p_brand")).alias("drug"), positive_flag(group, kind).alias("positive"))
    points = own.join(named(organisms), F.col("l_partkey") == F.col("p_partkey")).select(
        "subject", "encounter", "t", "type", "name", "method",
        "organism_id", "organism_name", "organism_category", "organism_group", "drug", F.col("l_returnflag").alias("sir"), "positive",
    )
    return Frames(encounters, stays, of_method(points, "culture"))


def hourly_binding(spark: SparkSession, d: str) -> Frames:
    """Users as encounters, groups of them as subjects, signups as stays of value quarter-hours, all other events as points; spans hours."""
    events = _read(spark, d, "events").withColumn("encounter", F.col("user_id").cast("string")).withColumn("subject", (F.col("user_id") % 200).cast("string"))
    end = F.timestamp_add("MICROSECOND", F.round(F.col("value") * 9e8).cast("bigint"), F.col("ts"))
    stays = events.filter("event_type = 'signup'").select("subject", "encounter", F.col("ts").alias("t_in"), end.alias("t_out"), F.lit(None).cast("timestamp_ntz").alias("discharge"), F.lit(None).cast("timestamp_ntz").alias("admit"))
    organism = (F.regexp_extract("props", r"([0-9]+)", 1).try_cast("bigint") % 12).cast("string")
    positive = F.coalesce(F.col("value") > 50, F.lit(False))
    points = events.filter("event_type <> 'signup'").select("subject", "encounter", F.col("ts").alias("t"), F.col("event_type").alias("type"), F.col("event_type").alias("name"), F.lit("culture").alias("method"), organism.alias("organism_name"), organism.alias("organism_category"), organism.alias("organism_group"), positive.alias("positive"))
    return Frames(events.select("subject", "encounter").distinct(), fill_open_end(stays), points)


def skewed_binding(spark: SparkSession, d: str) -> Frames:
    """The monthly binding with a third of all customers as one encounter, and stays of hours instead of days."""
    f = monthly_binding(spark, d)
    hot = F.col("encounter").cast("bigint") % 3 == 0
    as_one = lambda df: df.withColumns({c: F.when(hot, "all").otherwise(F.col(c)) for c in ("subject", "encounter")})
    short = F.timestamp_add("MICROSECOND", F.floor(F.timestamp_diff("MICROSECOND", F.col("t_in"), F.col("t_out")) / 24), F.col("t_in"))
    return Frames(f.encounters, as_one(f.stays.withColumn("t_out", short)), as_one(f.points))


def _pick(values: list[str], place: Column) -> Column:
    """The value at a place (from 0), which goes round."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(place, F.lit(len(values))) + 1).cast("int"))


#: Names beyond the codes of the taxonomy, as laboratories write them.
FREE_NAMES = [
    "staphylococcus_aureus", "methicillin resistant staphylococcus aureus", "staph aureus (mrsa)", "coagulase negative staphylococcus", "enterococcus_faecium", "vancomycin-resistant enterococcus", "vre screen",
    "escherichia coli", "e. coli esbl", "klebsiella_pneumoniae", "carbapenem resistant klebsiella", "kpc carrier", "pseudomonas_aeruginosa", "candida_auris", "clostridioides difficile", "acid fast bacilli", "mixed flora",
    "gram positive cocci", "no growth at 5 days", "none isolated", "not isolated", "no pathogen detected", "negative for yeast", "unidentified", "",
]
SPECIMENS = ["blood culture", "blood - peripheral line", "urine clean catch", "sputum expectorated", "bronchoalveolar lavage", "bronch wash", "deep wound swab", "stool sample", "csf", "pleural fluid"]
DRUGS = ["oxacillin", "vancomycin", "meropenem", "cefazolin", "ertapenem 10 mcg", "gentamicin", "cefoxitin screen"]
NAMES = [code for codes in CLASS_CODES.values() for code in codes] + FREE_NAMES


def named_organisms(organisms: DataFrame) -> DataFrame:
    """The parts with names of real organisms, dealt by their number."""
    number = F.col("organism_id").cast("bigint")
    code = _pick(NAMES, number)
    named = organisms.withColumns({"organism_category": code, "organism_name": F.when(number % 5 == 0, "").otherwise(F.translate(code, "_", " ")), "organism_group": F.when(code.isin("no_growth", ""), code)})
    return named.withColumn("positive", positive_flag(F.col("organism_group"), F.col("organism_category"), blank_is_missing=True))


def named_binding(spark: SparkSession, d: str) -> Frames:
    """The monthly binding with names of real organisms, specimens and drugs, dealt by the number of the part."""
    f = monthly_binding(spark, d, named_organisms)
    number = F.col("organism_id").cast("bigint")
    points = f.points.withColumns({"type": _pick(SPECIMENS, F.floor(number / 7)), "drug": _pick(DRUGS, F.floor(number / 3) + F.length("sir") + F.month("t"))})
    return Frames(f.encounters, f.stays, points)


_EPISODES = """
flag AS (SELECT *, CASE WHEN t_in <= max(t_out) OVER (PARTITION BY encounter ORDER BY t_in, t_out ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM stays),
num AS (SELECT *, sum(fresh) OVER (PARTITION BY encounter ORDER BY t_in, t_out ROWS UNBOUNDED PRECEDING) AS seq FROM flag),
episodes AS (SELECT any_value(subject) AS subject, encounter, CAST(seq AS BIGINT) AS seq, min(t_in) AS t_in, max(t_out) AS t_out, bool_or(open_end) AS any_open_end, count(*) AS n_intervals, date_trunc('month', min(t_in)) AS month FROM num GROUP BY encounter, seq),
attached AS (SELECT p.*, e.seq, e.t_in, e.t_out FROM points p JOIN episodes e ON p.encounter = e.encounter AND p.t BETWEEN e.t_in AND e.t_out),
events_ AS (SELECT *, CAST(floor(hours / 24) AS BIGINT) + 1 AS day FROM (
  SELECT any_value(subject) AS subject, encounter, seq, t_in, t_out, t, type, name, count(*) AS n_rows, bool_or(positive) AS any_positive, string_agg(DISTINCT organism_group, '; ' ORDER BY organism_group) AS organism_groups,
  date_trunc('month', t) AS month, date_diff('microsecond', t_in, t) / 3.6e9 AS hours FROM attached GROUP BY encounter, seq, t_in, t_out, t, type, name)),
detections AS (SELECT *, encounter || '|' || seq || '|' || t || '|' || type || '|' || name AS event_id, date_trunc('month', t) AS month, date_diff('microsecond', t_in, t) / 3.6e9 AS hours
  FROM attached WHERE positive AND NOT regexp_matches(lower(coalesce(organism_name, '')), '^(no|none|not) .*isolated|no growth|no .* detected|negative for')),
"""
MONTHLY_SQL = (
    """WITH enc AS (SELECT CAST(o_custkey % 500 AS VARCHAR) AS subject, CAST(o_custkey AS VARCHAR) AS encounter, min(o_orderdate) AS admit, max(o_orderdate) + INTERVAL 30 DAY AS discharge FROM orders GROUP BY 1, 2),
li AS (SELECT CAST(o_custkey % 500 AS VARCHAR) AS subject, CAST(o_custkey AS VARCHAR) AS encounter, * FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
raw AS (SELECT encounter, l_shipdate AS t_in, CASE WHEN l_linenumber = 1 AND l_linestatus = 'O' THEN NULL ELSE l_shipdate + CAST(l_quantity AS INTEGER) * INTERVAL 1 DAY END AS t_out FROM li WHERE l_returnflag = 'R'),
stays AS (SELECT subject, encounter, t_in, coalesce(t_out, discharge) AS t_out, t_out IS NULL AS open_end FROM raw JOIN enc USING (encounter) WHERE coalesce(t_out, discharge) > t_in),
points AS (SELECT subject, encounter, o_orderdate AS t, lower(trim(o_orderpriority)) AS type, lower(trim(o_orderstatus)) AS name, CAST(l_partkey AS VARCHAR) AS organism_id, lower(trim(p_name)) AS organism_name, lower(trim(p_type)) AS organism_category,
  CASE WHEN p_type = 'ECONOMY' THEN 'no_growth' ELSE lower(trim(p_type)) END AS organism_group, lower(p_brand) AS drug, l_returnflag AS sir, p_type <> 'ECONOMY' AS positive FROM li JOIN part ON l_partkey = p_partkey WHERE o_orderstatus <> 'P'),"""
    + _EPISODES
)
HOURLY_SQL = (
    """WITH stays AS (SELECT * FROM (SELECT CAST(user_id % 200 AS VARCHAR) AS subject, CAST(user_id AS VARCHAR) AS encounter, ts AS t_in, ts + to_microseconds(CAST(round(value * 9e8) AS BIGINT)) AS t_out, FALSE AS open_end FROM events WHERE event_type = 'signup') WHERE t_out > t_in),
points AS (SELECT CAST(user_id % 200 AS VARCHAR) AS subject, CAST(user_id AS VARCHAR) AS encounter, ts AS t, event_type AS type, event_type AS name, CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 12 AS VARCHAR) AS organism_name, CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 12 AS VARCHAR) AS organism_category, CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 12 AS VARCHAR) AS organism_group, value > 50 AS positive FROM events WHERE event_type <> 'signup'),"""
    + _EPISODES
)


def _over_monthly(stays: str, points: str) -> str:
    """The monthly binding with stays and points made from stays0 and points0."""
    head = MONTHLY_SQL.removesuffix(_EPISODES).replace("\nstays AS", "\nstays0 AS").replace("\npoints AS", "\npoints0 AS")
    return f"{head}\nstays AS ({stays}),\npoints AS ({points}),{_EPISODES}"


_AS_ONE = "CASE WHEN CAST(encounter AS BIGINT) % 3 = 0 THEN 'all' ELSE {c} END AS {c}"
_ONE = ", ".join(_AS_ONE.format(c=c) for c in ("subject", "encounter"))
SKEWED_SQL = _over_monthly(
    f"SELECT * REPLACE ({_ONE}, t_in + to_microseconds(date_diff('microsecond', t_in, t_out) // 24) AS t_out) FROM stays0",
    f"SELECT * REPLACE ({_ONE}) FROM points0",
)


def _picked(values: list[str], place: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][1 + CAST({place} AS BIGINT) % {len(values)}]"


_NUMBER = "CAST(organism_id AS BIGINT)"
NAMED_SQL = _over_monthly(
    "SELECT * FROM stays0",
    f"""SELECT * REPLACE (coalesce(nullif(organism_group, ''), nullif(organism_category, '')) IS NOT NULL AND coalesce(nullif(organism_group, ''), nullif(organism_category, '')) NOT IN ('no_growth', 'no growth') AS positive) FROM (
    SELECT * EXCLUDE (code) REPLACE (code AS organism_category, CASE WHEN {_NUMBER} % 5 = 0 THEN '' ELSE replace(code, '_', ' ') END AS organism_name, CASE WHEN code IN ('no_growth', '') THEN code END AS organism_group,
      {_picked(SPECIMENS, f"{_NUMBER} // 7")} AS type, {_picked(DRUGS, f"{_NUMBER} // 3 + length(sir) + month(t)")} AS drug) FROM (SELECT *, {_picked(NAMES, _NUMBER)} AS code FROM points0))""",
)
