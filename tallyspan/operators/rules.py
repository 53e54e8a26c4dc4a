"""Rules as data: pattern tables of any length, keyed seed tables, resistance rules over folded drugs.

All three judge distinct values alone, whatever the number of rows that bear them, and join the verdicts back; the
verdicts are broadcast if their count is within the bound, else both sides are shuffled and Spark may split a hot value.

Edge cases: a null value is judged as an empty text. Empty tables give an empty result, empty rule tables no match.
Extra columns pass through; names of results that the table has already are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import norm_sir, norm_text
from ..functions.taxonomy import CLASS_CODES, DEFAULT_CLASS, PHENOTYPES, RULESETS, first_match
from ..sources.store import stored
from .skew import joined

GRAM = 3


def numbered_patterns(table: DataFrame, pattern: str, group: str, order: str | None = None) -> DataFrame:
    """pattern, group, place of a pattern table: in the order of a column, or of the rows of its file. Blank patterns go."""
    place = F.col(order).cast("bigint") if order else F.monotonically_increasing_id()
    return table.select(F.lower(pattern).alias("pattern"), F.col(group).alias("group"), place.alias("place")).filter("pattern <> ''")


def grams(text: Column, size: int) -> Column:
    """All distinct parts of `size` characters of text; none where it is shorter."""
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(size))))


def first_patterns(values: DataFrame, patterns: DataFrame, gram: int = GRAM) -> DataFrame:
    """value, group, place, pattern: of all patterns (pattern, group, place) that a value contains the one of the smallest place.

    Every pattern is anchored at one of its parts of `gram` characters (all of it, where it is shorter), the one that
    fewest patterns have; values meet patterns at equal anchors only, and are searched for what they meet. A value
    is cut into its parts once, however many patterns there are.
    """
    size = F.least(F.length("pattern"), F.lit(gram))
    parts = F.coalesce(*[F.when(size == k, grams(F.col("pattern"), k)) for k in range(1, gram + 1)])
    cut = stored(patterns.select("pattern", "group", "place", size.alias("size"), F.explode(parts).alias("part")))
    shared = cut.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min_by("part", F.struct("n", "part")).alias("part")
    anchors = stored(cut.join(shared, "part").groupBy("pattern", "group", "place", "size").agg(rarest))
    sizes = [r.size for r in anchors.select("size").distinct().collect()]
    if not sizes:
        return values.select("value", *[F.lit(None).cast(kind).alias(c) for c, kind in (("group", "string"), ("place", "bigint"), ("pattern", "string"))]).limit(0)
    own = F.array_distinct(F.flatten(F.array(*[grams(F.col("value"), k) for k in sorted(sizes)])))
    met = values.select("value", F.explode(own).alias("part")).join(anchors, "part").filter(F.contains("value", "pattern"))
    first = F.min(F.struct("place", "pattern", "group")).alias("first")
    return met.groupBy("value").agg(first).select("value", "first.group", "first.place", "first.pattern")


def with_verdict(df: DataFrame, text: Column, verdict: DataFrame) -> DataFrame:
    """df with the columns of verdict, joined by the cleaned text (value); rows without one get nulls."""
    verdict = stored(verdict)
    kept = df.drop(*[c for c in verdict.columns if c != "value"]).withColumn("__value", F.lower(F.coalesce(text, F.lit(""))))
    return joined(kept, verdict.withColumnRenamed("value", "__value"), ("__value",), "left", verdict.count()).drop("__value")


def distinct_values(df: DataFrame, text: Column) -> DataFrame:
    return df.select(F.lower(F.coalesce(text, F.lit(""))).alias("value")).distinct()


def match_patterns(df: DataFrame, text: Column, patterns: DataFrame, gram: int = GRAM) -> DataFrame:
    """df with group, place and pattern of the first pattern of the table that text contains, case aside; null where none does."""
    return with_verdict(df, text, first_patterns(distinct_values(df, text), patterns, gram))


def seed_table(spark: SparkSession, classes: dict[str, list[str]] = CLASS_CODES) -> DataFrame:
    """code, class of every listed code."""
    rows = [F.struct(F.lit(label).alias("class"), F.array(*map(F.lit, codes)).alias("codes")) for label, codes in classes.items()]
    return spark.range(1).select(F.inline(F.array(*rows))).select(F.explode("codes").alias("code"), "class")


def classify_codes(df: DataFrame, code: Column, seeds: DataFrame, rules: list[tuple[str, str]] | None = None, default: str = DEFAULT_CLASS) -> DataFrame:
    """df with class and path: `exact` by the seed table (code, class), else `rule` by the first pattern that matches, else `default`.

    Patterns run once for each distinct code that the seed table lacks. Of codes that the table has twice the
    smallest class counts.
    """
    rules = rules or RULESETS["exact_then_regex"]
    known = stored(seeds.groupBy(F.lower("code").alias("value")).agg(F.min("class").alias("seed")))
    values = joined(distinct_values(df, code), known, ("value",), "left", known.count())
    values = stored(values)
    left = values.filter("seed IS NULL").select("value", first_match(F.col("value"), rules, None).alias("ruled"))
    left = left.select("value", F.coalesce("ruled", F.lit(default)).alias("class"), F.when(F.col("ruled").isNull(), "default").otherwise("rule").alias("path"))
    exact = values.filter("seed IS NOT NULL").select("value", F.col("seed").alias("class"), F.lit("exact").alias("path"))
    return with_verdict(df, code, exact.unionByName(left))


def resistance_labels(detections: DataFrame, susceptibility: DataFrame, text: Column, rules: list[tuple[str, str, str]] = PHENOTYPES) -> DataFrame:
    """The columns of detections and target_label, distinct: for each resistant drug of the detection's organism_id the first rule (label, organism pattern, drug pattern) that fits both.

    susceptibility: organism_id, antimicrobial, interpretation. A drug is reduced to the set of rules that it fits,
    an organism to the distinct sets of its resistant drugs, before anything is joined: so an organism_id is one row
    whatever the number of its results, and the join gives one row a detection.
    """
    drug = norm_text(F.col("antimicrobial"))
    fits = sum((F.when(drug.rlike(d), 1 << k).otherwise(0) for k, (_, _, d) in enumerate(rules)), F.lit(0))
    resistant = susceptibility.filter((F.col("organism_id") != "") & (norm_sir(F.col("interpretation")) == "resistant"))
    folded = resistant.select("organism_id", fits.alias("fits")).filter("fits > 0").groupBy("organism_id").agg(F.collect_set("fits").alias("__fits"))
    folded = stored(folded)
    rows = detections.drop("target_label").withColumn("__organisms", F.array(*[text.rlike(o) for _, o, _ in rules]))
    rows = joined(rows.filter(F.col("organism_id") != ""), folded, ("organism_id",), small=folded.count())

    def first(fits: Column) -> Column:
        out = F.lit(None).cast("string")
        for k, (label, _, _) in reversed(list(enumerate(rules))):
            out = F.when((fits.bitwiseAND(1 << k) > 0) & F.element_at("__organisms", k + 1), label).otherwise(out)
        return out

    labels = F.array_distinct(F.array_compact(F.transform("__fits", first)))
    return rows.withColumn("target_label", F.explode(labels)).drop("__organisms", "__fits").distinct()
