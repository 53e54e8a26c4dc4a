"""Registered queries over names of real organisms, specimens and drugs: rules as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import display_label, first_known, n_distinct, negative_name
from ..functions.taxonomy import CLASS_CODES, DEFAULT_CLASS, ORGANISM_GROUPS, PHENOTYPES, RULESETS, SPECIMEN_GROUPS, TARGETS, tag_targets
from ..operators import calendar as cal
from ..operators.rules import classify_codes, match_patterns, numbered_patterns, resistance_labels, seed_table
from ..sources.io import optional_table, read_table
from ..sources.store import shared_folder, stored
from .frames import Frames, monthly_binding, named_binding
from .queries import register
from .reports import ALIASES, SUSCEPTIBILITY


def text() -> Column:
    """What targets and phenotypes are looked for in."""
    return F.lower(F.concat_ws(" ", "organism_name", "organism_category"))


def row_counts(f: Frames, column: str) -> DataFrame:
    """Point rows (n) of each value of a column, stored: rules read their table twice, for its values and for the verdicts."""
    return stored(f.points.groupBy(column).agg(F.count(F.lit(1)).alias("n")))


_TEXT = "lower(concat_ws(' ', organism_name, organism_category))"


def _case(x: str, rules: list[tuple[str, str]], default: str = "NULL") -> str:
    """The label of the first (label, pattern) as SQL."""
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{label}'" for label, p in rules) + f" ELSE {default} END"


_SEEDS = ", ".join(f"('{c}', '{label}')" for label, codes in CLASS_CODES.items() for c in codes)


@register("classify_codes", named_binding, f"""seeds AS (SELECT * FROM (VALUES {_SEEDS}) AS t(code, class)),
c AS (SELECT coalesce(organism_category, '') AS code, count(*) AS n_rows FROM points GROUP BY 1),
r AS (SELECT c.*, seeds.class AS seed, {_case("lower(c.code)", RULESETS["exact_then_regex"])} AS ruled FROM c LEFT JOIN seeds ON lower(c.code) = seeds.code)
SELECT code, coalesce(seed, ruled, '{DEFAULT_CLASS}') AS class, CASE WHEN seed IS NOT NULL THEN 'exact' WHEN ruled IS NOT NULL THEN 'rule' ELSE 'default' END AS path, n_rows FROM r""")
def _(f: Frames) -> DataFrame:
    """The class of every code and how it was found: by the table of codes, by a pattern, or not at all."""
    rows = classify_codes(row_counts(f, "organism_category"), F.col("organism_category"), seed_table(f.points.sparkSession))
    return rows.groupBy(F.coalesce("organism_category", F.lit("")).alias("code"), "class", "path").agg(F.sum("n").alias("n_rows"))


@register("monthly_classes", named_binding, f"""seeds AS (SELECT * FROM (VALUES {_SEEDS}) AS t(code, class)),
r AS (SELECT d.month, d.event_id, coalesce(seeds.class, {_case("lower(d.organism_category)", RULESETS["exact_then_regex"])}, '{DEFAULT_CLASS}') AS class FROM detections d LEFT JOIN seeds ON lower(d.organism_category) = seeds.code)
SELECT month, class, count(*) AS n_rows, count(DISTINCT event_id) AS n_events FROM r GROUP BY 1, 2""")
def _(f: Frames) -> DataFrame:
    """Detections of each class by month."""
    rows = classify_codes(f.once("detections"), F.col("organism_category"), seed_table(f.points.sparkSession))
    return rows.groupBy("month", "class").agg(F.count(F.lit(1)).alias("n_rows"), n_distinct("event_id").alias("n_events"))


def pattern_file(f: Frames, rules: list[tuple[str, str]], name: str) -> DataFrame:
    """A pattern table as sites keep it, a CSV file with a header, read like any other source."""
    root, spark = shared_folder(f.points.sparkSession), f.points.sparkSession
    rows = [F.struct(F.lit(p).alias(f"{name}_pattern"), F.lit(g).alias(f"{name}_group"), F.lit("").alias("notes")) for p, g in rules]
    spark.range(1).select(F.inline(F.array(*rows))).coalesce(1).write.option("header", True).csv(f"{root}/{name}_groups.csv")
    return numbered_patterns(read_table(spark, root, f"{name}_groups", "csv"), f"{name}_pattern", f"{name}_group")


def _contains(x: str, rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({x}), '{p}') THEN '{g}'" for p, g in rules) + " END"


@register("specimen_groups", named_binding, f"z AS (SELECT 1) SELECT type, {_contains('type', SPECIMEN_GROUPS)} AS specimen_group, count(*) AS n_rows FROM points GROUP BY ALL")
def _(f: Frames) -> DataFrame:
    """The group of every specimen by the pattern table of specimens."""
    rows = match_patterns(row_counts(f, "type"), F.col("type"), pattern_file(f, SPECIMEN_GROUPS, "specimen"))
    return rows.groupBy("type", F.col("group").alias("specimen_group")).agg(F.sum("n").alias("n_rows"))


@register("organism_groups", named_binding, f"z AS (SELECT 1) SELECT {_contains('organism_name', ORGANISM_GROUPS)} AS organism_class, count(*) AS n_rows, count(DISTINCT event_id) AS n_events FROM detections GROUP BY ALL")
def _(f: Frames) -> DataFrame:
    """Detections of every group by the pattern table of organisms."""
    rows = match_patterns(stored(f.detections.select("organism_name", "event_id")), F.col("organism_name"), pattern_file(f, ORGANISM_GROUPS, "organism"))
    return rows.groupBy(F.col("group").alias("organism_class")).agg(F.count(F.lit(1)).alias("n_rows"), n_distinct("event_id").alias("n_events"))


N_PATTERNS = 300


@register("pattern_table_large", monthly_binding, f"""p AS (SELECT i AS place, lpad(CAST(i * 37 % 1000 AS VARCHAR), 3 - CAST(i % 10 = 0 AS INT), '0') AS pattern, 'group ' || i % 11 AS "group" FROM range({N_PATTERNS}) AS t(i)),
x AS (SELECT DISTINCT lpad(CAST(CAST(organism_id AS BIGINT) * 7919 % 1000000 AS VARCHAR), 6, '0') AS code, organism_id FROM points),
m AS (SELECT organism_id, min(place) AS place FROM x JOIN p ON contains(code, pattern) GROUP BY 1)
SELECT p."group" AS code_group, m.place, count(*) AS n_rows FROM points LEFT JOIN m USING (organism_id) LEFT JOIN p USING (place) GROUP BY 1, 2""")
def _(f: Frames) -> DataFrame:
    """A table of three hundred patterns of two and three characters; the first by its place counts."""
    i = F.col("id")
    code = (i * 37 % 1000).cast("string")
    pattern = F.when(i % 10 == 0, F.lpad(code, 2, "0")).otherwise(F.lpad(code, 3, "0"))
    table = f.points.sparkSession.range(N_PATTERNS).select(i.alias("at"), pattern.alias("pattern"), F.concat(F.lit("group "), (i % 11).cast("string")).alias("name"))
    digits = F.lpad((F.col("organism_id").cast("bigint") * 7919 % 1000000).cast("string"), 6, "0")
    rows = match_patterns(row_counts(f, "organism_id"), digits, numbered_patterns(table, "pattern", "name", "at"))
    return rows.groupBy(F.col("group").alias("code_group"), "place").agg(F.sum("n").alias("n_rows"))


_TARGET_ROWS = ", ".join(f"('{label}', '{p}')" for label, p in TARGETS)


@register("named_targets", named_binding, f"""t AS (SELECT * FROM (VALUES {_TARGET_ROWS}) AS t(target_label, pattern))
SELECT month, target_label, count(*) AS n_rows, count(DISTINCT event_id) AS n_events FROM detections JOIN t ON regexp_matches({_TEXT}, pattern) GROUP BY 1, 2""")
def _(f: Frames) -> DataFrame:
    """Detections of the named targets, by the text of name and category."""
    rows = tag_targets(f.detections, text())
    return rows.groupBy("month", "target_label").agg(F.count(F.lit(1)).alias("n_rows"), n_distinct("event_id").alias("n_events"))


_PHENO = "CASE " + " ".join(f"WHEN regexp_matches({_TEXT}, '{o}') AND regexp_matches(lower(trim(s.drug)), '{d}') THEN '{label}'" for label, o, d in PHENOTYPES) + " END"


@register("named_phenotypes", named_binding, f"""s AS (SELECT DISTINCT organism_id, drug FROM points WHERE sir = 'R'),
p AS (SELECT DISTINCT d.month, d.event_id, {_PHENO} AS target_label FROM detections d JOIN s ON s.organism_id = d.organism_id)
SELECT 'with table' AS sources, month, target_label, count(*) AS n_events FROM p WHERE target_label IS NOT NULL GROUP BY ALL""")
def _(f: Frames) -> DataFrame:
    """Phenotypes by the results of the susceptibility table, which other sites name otherwise or lack; without it there are none."""
    spark, root = f.points.sparkSession, shared_folder(f.points.sparkSession)
    named = f.points.select(F.col("organism_id").alias("microbiology_organism_id"), F.initcap("drug").alias("antibiotic_name"), F.when(F.col("sir") == "R", "Resistant").otherwise(F.col("sir")).alias("susceptibility_result"))
    named.write.parquet(f"{root}/there/Microbiology_Susceptibility.parquet")
    f.once("detections").limit(0).write.parquet(f"{root}/absent/other.parquet")
    out = []
    for sources, folder in (("with table", "there"), ("without table", "absent")):
        table = optional_table(spark, f"{root}/{folder}", "microbiology_susceptibility", SUSCEPTIBILITY, aliases=ALIASES)
        rows = f.once("detections").select("month", "event_id", "organism_id", "organism_name", "organism_category")
        rows = resistance_labels(rows, table, text()).select("month", "event_id", "target_label").distinct()
        out.append(rows.groupBy("month", "target_label").agg(F.count(F.lit(1)).alias("n_events")).withColumn("sources", F.lit(sources)))
    return out[0].unionByName(out[1])


@register("excluded_names", named_binding, "z AS (SELECT 1) SELECT organism_name, count(*) AS n_excluded FROM attached WHERE positive AND regexp_matches(lower(organism_name), '^(no|none|not) .*isolated|no growth|no .* detected|negative for') GROUP BY 1")
def _(f: Frames) -> DataFrame:
    """Names that say that nothing was found though their category counts as a result."""
    return f.attached.filter(F.col("positive") & negative_name(F.col("organism_name"))).groupBy("organism_name").agg(F.count(F.lit(1)).alias("n_excluded"))


_LABEL = "coalesce(nullif(organism_name, ''), nullif(organism_category, ''), nullif(organism_group, ''), 'missing')"
_SHOWN = "upper(substr({x}, 1, 1)) || lower(substr({x}, 2))".format(x="replace(label, '_', ' ')")


@register("fallback_labels", named_binding, f"l AS (SELECT {_LABEL} AS label, any_positive FROM (SELECT *, positive AS any_positive FROM points)) SELECT {_SHOWN} AS label, count(*) AS n_rows FROM l GROUP BY 1")
def _(f: Frames) -> DataFrame:
    """The name of every row, else its category, else its group, else `missing`."""
    label = first_known(F.col("organism_name"), F.col("organism_category"), F.col("organism_group"))
    return f.points.groupBy(display_label(label).alias("label")).agg(F.count(F.lit(1)).alias("n_rows"))


_CELLS = "c AS (SELECT month, type, count(*) AS n_events, count(*) FILTER (WHERE any_positive) AS n_positive FROM events_ GROUP BY 1, 2)"


@register("minimum_cells", named_binding, _CELLS + """ SELECT 10 AS least, month, type, n_events, round(100.0 * n_positive / n_events, 6) AS percent_positive FROM c WHERE n_events >= 10
UNION ALL SELECT 1, month, type, n_events, round(100.0 * n_positive / n_events, 6) FROM c WHERE n_events > 0""")
def _(f: Frames) -> DataFrame:
    """Positivity where a month has ten events of a type or more, and where it has any."""
    counts = stored(f.events.groupBy("month", "type").agg(F.count(F.lit(1)).alias("n_events"), F.count_if("any_positive").alias("n_positive")))
    rows = [cal.at_least(counts, "n_events", least).withColumn("least", F.lit(least)) for least in (10, 1)]
    percent = F.round(F.try_divide(100.0 * F.col("n_positive"), F.col("n_events")), 6)
    return rows[0].unionByName(rows[1]).select("least", "month", "type", "n_events", percent.alias("percent_positive"))


@register("ranked_in_class", named_binding, f"""seeds AS (SELECT * FROM (VALUES {_SEEDS}) AS t(code, class)),
r AS (SELECT d.organism_category AS organism, coalesce(seeds.class, {_case("lower(d.organism_category)", RULESETS["exact_then_regex"])}, '{DEFAULT_CLASS}') AS class, count(*) AS n_rows FROM detections d LEFT JOIN seeds ON lower(d.organism_category) = seeds.code GROUP BY 1, 2)
SELECT class, organism, n_rows, CAST(row_number() OVER (PARTITION BY class ORDER BY n_rows DESC, organism) AS INTEGER) AS rank, count(*) OVER (PARTITION BY class) AS n_in_group FROM r""")
def _(f: Frames) -> DataFrame:
    """Organisms by rank in their class, with the number of organisms of the class."""
    rows = classify_codes(f.once("detections"), F.col("organism_category"), seed_table(f.points.sparkSession))
    counts = rows.groupBy("class", F.col("organism_category").alias("organism")).agg(F.count(F.lit(1)).alias("n_rows"))
    return cal.ranked_within(counts, "class", F.desc("n_rows"), F.asc_nulls_last("organism"))
