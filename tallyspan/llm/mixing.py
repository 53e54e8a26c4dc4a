"""Mixing sources to target weights by Poisson replication.

A source's rate is its share of the target divided by its share of the corpus. Each document gets the
count that inverts the Poisson distribution of that mean at a uniform number hashed from doc_id and seed,
is exploded by its count, and all copies are shuffled by a hashed key. The same seed gives the same mix on
any partitioning. Built from DataFrame functions alone.

The distribution function of each source is one array, computed once for a source and long enough that
the uniform number, which has 52 bits, cannot pass its end. The table of sources is broadcast where it has
at most `broadcast_sources` rows; beyond that it is read from its files and joined by a shuffle that Spark
may split at a hot source.

Edge cases: null text counts no characters; a source without characters gets rate 1. Null sources form one
source, null doc_ids hash as the empty text. Repeated rows get equal counts. With explicit weights a source
that they don't name gets rate 0. An empty table gives an empty result. Extra columns pass
through unless they are named copy or shuffle_key, the names of results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, table, written

SEED, DAMPING = "mix-1", 0.7


def uniform(*parts: Column) -> Column:
    """A number from 0 to 1 (excluded) with 52 bits of the MD5 of the parts."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def distribution(rate: Column) -> Column:
    """P(count <= k) for k = 0, 1, ...; the tail beyond the last is under 2**-53. Sums are kept in logarithms' range."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.ln(rate) - F.ln(k.cast("double"))
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(acc["all"], F.array(total)).alias("all"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"]))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, damping: float = DAMPING, budget: float = 1.0) -> DataFrame:
    """__source, __rate, __steps of every source. Without weights a source's target is its characters to the power `damping`.

    `budget` is the size of the mix in characters, as a multiple of the corpus.
    """
    chars = F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("bigint"))
    sizes = docs.groupBy(F.col("source").alias("__source")).agg(chars.alias("__chars"))
    if weights is None:
        target = F.pow(F.col("__chars").cast("double"), F.lit(damping))
    else:
        target = F.lit(0.0)
        for source, weight in weights.items():
            target = F.when(F.col("__source").eqNullSafe(source), float(weight)).otherwise(target)
    sizes = written(sizes.withColumn("__target", target), shared_folder(docs.sparkSession), "sizes")
    total = sizes.agg(F.sum("__chars").alias("chars"), F.sum("__target").alias("target")).first()
    rate = F.lit(float(budget * (total.chars or 0) / (total.target or 1))) * F.col("__target") / F.col("__chars")
    rate = F.when(F.col("__chars") > 0, F.round(rate, 9)).otherwise(F.lit(1.0))
    return sizes.select("__source", rate.alias("__rate")).withColumn("__steps", distribution(F.col("__rate")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, damping: float = DAMPING, budget: float = 1.0, seed: str = SEED, broadcast_sources: int = 10_000) -> DataFrame:
    """The mixed rows of docs in their shuffled order, with copy (1, 2, ...) and shuffle_key."""
    own = docs.drop("copy", "shuffle_key")
    known = written(rates(docs, weights, damping, budget), shared_folder(docs.sparkSession), "rates")
    if known.count() <= broadcast_sources:
        known = F.broadcast(known)
    u = uniform(F.col("doc_id"), F.lit(seed))
    joined = own.join(known, own["source"].eqNullSafe(known["__source"]))
    counted = joined.withColumn("__count", F.coalesce(F.size(F.filter("__steps", lambda x: x < u)), F.lit(0)))
    counted = counted.filter("__count > 0 AND __steps IS NOT NULL").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__count"))))
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string"), F.lit(seed)))
    return counted.withColumn("shuffle_key", key).orderBy("shuffle_key").select(*own.columns, "copy", "shuffle_key")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus: doc_id, copy, source, shuffle_key, text."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "copy", "source", "shuffle_key", "text")


OP1_SQL = """
WITH sizes AS (SELECT source, sum(length(coalesce(text, ''))) AS chars FROM documents GROUP BY source),
t AS (SELECT sum(chars) AS chars, sum(pow(CAST(chars AS DOUBLE), 0.7)) AS target FROM sizes),
r AS (SELECT s.source, round(t.chars / t.target * pow(CAST(s.chars AS DOUBLE), 0.7) / s.chars, 9) AS rate FROM sizes s, t),
p AS (SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM r, (SELECT unnest(generate_series(0, 60)) AS k)),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
u AS (SELECT doc_id, source, text, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '|mix-1'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM documents),
n AS (SELECT u.doc_id, u.source, u.text, count(c.k) AS n FROM u JOIN c ON u.source = c.source AND c.cdf < u.u GROUP BY ALL),
e AS (SELECT doc_id, source, text, unnest(generate_series(1, n)) AS copy FROM n)
SELECT doc_id, CAST(copy AS INTEGER) AS copy, source, md5(CAST(doc_id AS VARCHAR) || '|' || CAST(copy AS VARCHAR) || '|mix-1') AS shuffle_key, text FROM e
"""
