"""Registered queries over the readers and writers: what is written comes back, is listed and is audited."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import display_label, month_of, norm_sir, norm_ts, try_cast
from ..operators.pooled import rate_ratios
from ..sources.io import conform, export_manifest, latest_run, optional_table, privacy_violations, read_sites, read_table, write_aggregate, write_private, write_sorted
from ..sources.store import shared_folder, stored
from .frames import Frames, monthly_binding
from .queries import register

SITE, RUN = "site-a", "2026-01-01T00-00"
#: The names under which susceptibility columns come.
ALIASES = {
    "organism_id": ["microbiology_organism_id"],
    "antimicrobial": ["antimicrobial_name", "antimicrobial_category", "antibiotic_name", "antibiotic", "drug_name", "susceptibility_name"],
    "interpretation": ["susceptibility_interpretation", "susceptibility_result", "result", "result_category"],
}
SUSCEPTIBILITY = T.StructType([T.StructField(c, T.StringType()) for c in ALIASES])
_MONTHLY = "c AS (SELECT date_trunc('month', t) AS month, type, count(*) AS n_rows FROM points GROUP BY 1, 2)"


def monthly_types(f: Frames) -> DataFrame:
    return f.points.groupBy(month_of(F.col("t")).alias("month"), "type").agg(F.count(F.lit(1)).alias("n_rows"))


def exported(f: Frames) -> str:
    """A folder with an aggregate as CSV and one as Parquet, stamped with site, care setting and run."""
    root = shared_folder(f.points.sparkSession)
    write_aggregate(monthly_types(f), f"{root}/monthly/Category_Counts.csv", SITE, RUN, "csv")
    write_aggregate(f.points.groupBy("type").agg(F.count(F.lit(1)).alias("n_rows")), f"{root}/types.parquet", SITE, RUN)
    return root


@register("read_back_csv", monthly_binding, _MONTHLY + f" SELECT month, type, n_rows, 'ICU' AS care_setting, '{SITE}' AS site_name FROM c")
def _(f: Frames) -> DataFrame:
    """An aggregate written as CSV, located whatever the case of its name, and typed by its values."""
    back = read_table(f.points.sparkSession, exported(f), "category_counts", "csv")
    kinds = T.StructType.fromDDL("month timestamp_ntz, type string, n_rows bigint, care_setting string, site_name string")
    return conform(back, kinds, required=("month",))


@register("export_manifest", monthly_binding, _MONTHLY + f""", m AS (
  SELECT 'monthly/Category_Counts.csv' AS dataset, count(*) AS rows, 6 AS n_columns, 'month; type; n_rows; care_setting; site_name; run_ts' AS columns FROM c
  UNION ALL SELECT 'types.parquet', count(DISTINCT type), 5, 'type; n_rows; care_setting; site_name; run_ts' FROM points)
SELECT '{SITE}' AS site_name, 'ICU' AS care_setting, *, true AS has_bytes, true AS dated FROM m""")
def _(f: Frames) -> DataFrame:
    """The manifest of the exports; sizes and times differ by run, so only that they are there is told."""
    out = export_manifest(f.points.sparkSession, exported(f), {"monthly/Category_Counts.csv": "csv", "types.parquet": "parquet"}, SITE)
    return out.withColumns({"has_bytes": F.col("size_bytes") > 0, "dated": F.col("created_at").isNotNull()}).drop("size_bytes", "created_at")


@register("privacy_violations", monthly_binding, """z AS (SELECT count(*) AS n FROM points)
SELECT 'private' AS dataset, unnest(['patient_id', 'Collect_Dttm', 'seen_datetime']) AS column FROM z WHERE n > 0""")
def _(f: Frames) -> DataFrame:
    """The identifiers and exact times among the columns of a row-level table and of the aggregates beside it."""
    spark, root = f.points.sparkSession, exported(f)
    rows = f.points.select(F.col("subject").alias("patient_id"), "type", F.col("t").alias("Collect_Dttm"), F.col("t").alias("seen_datetime"))
    write_private(rows, f"{root}/private", RUN)
    return privacy_violations(export_manifest(spark, root, {"monthly/Category_Counts.csv": "csv", "types.parquet": "parquet", "private": "parquet"}, SITE))


@register("latest_run", monthly_binding, "z AS (SELECT 1) SELECT type, count(*) AS n_rows FROM points WHERE name = 'f' GROUP BY 1")
def _(f: Frames) -> DataFrame:
    """Of two runs of one output the newer."""
    path = f"{shared_folder(f.points.sparkSession)}/runs"
    for run, rows in (("2026-01-01", f.points), ("2026-02-01", f.points.filter("name = 'f'"))):
        write_private(rows.groupBy("type").agg(F.count(F.lit(1)).alias("n_rows")), path, run)
    return latest_run(f.points.sparkSession.read.parquet(path)).drop("run_ts")


@register("optional_sources", monthly_binding, """z AS (SELECT 1)
SELECT CASE sir WHEN 'R' THEN 'resistant' ELSE lower(sir) END AS interpretation, count(*) AS n_rows, count(DISTINCT drug) AS n_drugs, 0 AS n_missing_table FROM points GROUP BY 1""")
def _(f: Frames) -> DataFrame:
    """A table with other column names conforms by its aliases; a table that isn't there is an empty one."""
    spark = f.points.sparkSession
    named = f.points.select(F.col("organism_id").alias("microbiology_organism_id"), F.col("drug").alias("drug_name"), F.col("sir").alias("result"))
    rows = conform(named, SUSCEPTIBILITY, ALIASES)
    counts = rows.groupBy(norm_sir(F.col("interpretation")).alias("interpretation")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("antimicrobial").alias("n_drugs"))
    missing = optional_table(spark, exported(f), "susceptibility", SUSCEPTIBILITY)
    return counts.crossJoin(missing.agg(F.count(F.lit(1)).cast("int").alias("n_missing_table")))


@register("text_columns", monthly_binding, """z AS (SELECT 1)
SELECT date_trunc('month', t) AS month, upper(substr(x, 1, 1)) || lower(substr(x, 2)) AS label, CASE WHEN positive THEN true ELSE false END AS positive, count(*) AS n_rows
FROM (SELECT *, replace(type, '-', ' ') AS x FROM points) GROUP BY 1, 2, 3""")
def _(f: Frames) -> DataFrame:
    """Times, labels and flags that come as text: parsed, shown and cast."""
    text = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    raw = f.points.select(text.alias("t"), F.translate("type", "-", "_").alias("type"), F.col("positive").cast("string").alias("positive"))
    clean = raw.select(month_of(norm_ts(F.col("t"), "string")).alias("month"), display_label(F.col("type")).alias("label"), try_cast(F.col("positive"), "boolean").alias("positive"))
    return clean.groupBy("month", "label", "positive").agg(F.count(F.lit(1)).alias("n_rows"))


@register("repeated_export", monthly_binding, """z AS (SELECT 1)
SELECT site_name, run_ts, type, count(*) AS n_rows FROM (
  SELECT 'site-a' AS site_name, '2026-01-01T00-00' AS run_ts, type FROM points WHERE name = 'f' UNION ALL SELECT 'site-a', '2026-02-01T00-00', type FROM points
  UNION ALL SELECT 'site-b', '2026-01-01T00-00', type FROM points WHERE name = 'o') GROUP BY ALL""")
def _(f: Frames) -> DataFrame:
    """Of two attempts at one site's run the later one stands; other sites and runs stay as they are."""
    spark, path = f.points.sparkSession, f"{shared_folder(f.points.sparkSession)}/export"
    later = "2026-02-01T00-00"
    for rows, site, run in ((f.points, SITE, later), (f.points.filter("name = 'o'"), "site-b", RUN), (f.points, SITE, RUN), (f.points.filter("name = 'f'"), SITE, RUN)):
        write_aggregate(rows.groupBy("type").agg(F.count(F.lit(1)).alias("n_rows")), path, site, run)
    return spark.read.parquet(path).select("site_name", "run_ts", "type", "n_rows")


_SITE = "CAST(CAST(encounter AS BIGINT) % 3 AS VARCHAR)"


@register("site_rate_ratios", monthly_binding, f"""e AS (SELECT {_SITE} AS site, month, count(*) AS n_events FROM events_ GROUP BY 1, 2), d AS (SELECT {_SITE} AS site, month, count(*) AS n_episodes FROM episodes GROUP BY 1, 2),
r AS (SELECT site, month, coalesce(n_events, 0)::DOUBLE AS x, n_episodes::DOUBLE AS t FROM d LEFT JOIN e USING (site, month)),
m AS (SELECT r.site AS site_name, count(*) AS n_strata, sum(r.x * b.t / (r.t + b.t)) AS p, sum(b.x * r.t / (r.t + b.t)) AS q, sum((r.x + b.x) * r.t * b.t / ((r.t + b.t) * (r.t + b.t))) AS v
  FROM r JOIN r b ON b.month = r.month AND b.site = '0' WHERE r.site <> '0' GROUP BY 1)
SELECT site_name, n_strata, round(p / q, 6) AS ratio, round(exp(ln(p / q) - 1.959963984540054 * sqrt(v / (p * q))), 6) AS low, round(exp(ln(p / q) + 1.959963984540054 * sqrt(v / (p * q))), 6) AS high FROM m""")
def _(f: Frames) -> DataFrame:
    """The event rate of each site against that of site 0, over months as strata, from the exports of the sites, whose columns differ."""
    spark, path = f.points.sparkSession, f"{shared_folder(f.points.sparkSession)}/rates"
    site = (F.col("encounter").cast("bigint") % 3).cast("string").alias("site")
    f.once("episodes")
    events = f.events.groupBy(site, "month").agg(F.count(F.lit(1)).alias("n_events"))
    counts = f.frame("episodes").groupBy(site, "month").agg(F.count(F.lit(1)).alias("n_episodes")).join(events, ["site", "month"], "left")
    counts = stored(counts.withColumn("n_events", F.coalesce("n_events", F.lit(0))))
    for k in range(3):
        own = counts.filter(F.col("site") == str(k)).drop("site")
        # Site 1 exports a column more, and site 2 has its columns in another order.
        own = [own, own.withColumn("note", F.lit("x")), own.select("n_events", "n_episodes", "month")][k]
        write_aggregate(own, path, f"site {k}", RUN)
    rows = read_sites(spark, path).withColumn("site_name", F.substring_index("site_name", " ", -1))
    out = rate_ratios(rows.select(F.col("site_name").cast("string").alias("site_name"), "month", "n_events", "n_episodes"), "site_name", "0", "month", "n_events", "n_episodes")
    return out.select("site_name", "n_strata", *[F.round(c, 6).alias(c) for c in ("ratio", "low", "high")])


@register("sorted_sink", monthly_binding, """c AS (SELECT t, type, count(*) AS n_rows FROM points GROUP BY 1, 2)
SELECT t, type, n_rows, CAST(row_number() OVER (ORDER BY t DESC, type) AS BIGINT) AS place FROM c""")
def _(f: Frames) -> DataFrame:
    """Rows written in order over several files; the place of each is told by the order of files and of rows in them."""
    spark, path = f.points.sparkSession, f"{shared_folder(f.points.sparkSession)}/sorted"
    write_sorted(f.points.groupBy("t", "type").agg(F.count(F.lit(1)).alias("n_rows")), path, F.desc("t"), F.asc("type"), files=4)
    back = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    files = back.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    # One row a file.
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = back.join(F.broadcast(files.select("file", earlier.alias("before"))), "file")
    return out.select("t", "type", "n_rows", (F.col("before") + F.col("at") + 1).alias("place"))


@register("private_columns", monthly_binding, """z AS (SELECT count(*) AS n FROM points WHERE name = 'f'), y AS (SELECT count(*) AS n FROM points WHERE name = 'no such name')
SELECT 'row_level' AS dataset, 'organism_id' AS column FROM z WHERE n > 0 UNION ALL SELECT 'row_level', 'collect_dttm' FROM z WHERE n > 0 UNION ALL SELECT 'row_level', 'patient_id' FROM y WHERE n > 0""")
def _(f: Frames) -> DataFrame:
    """The audit of columns that hold something: which names are forbidden follows from what the export's rows hold."""
    spark, root = f.points.sparkSession, shared_folder(f.points.sparkSession)
    rows = f.points.select(F.when(F.col("name") == "no such name", F.col("subject")).alias("patient_id"), F.when(F.col("name") == "f", F.col("organism_id")).alias("organism_id"), F.when(F.col("name") == "f", F.col("t")).alias("collect_dttm"), "type")
    held = rows.agg(*[F.count(c).alias(c) for c in rows.columns]).first()
    write_private(rows.select(*[c for c in rows.columns if held[c]]), f"{root}/row_level", RUN)
    return privacy_violations(export_manifest(spark, root, {"row_level": "parquet"}, SITE))
