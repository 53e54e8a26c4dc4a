"""Comparison of groups over strata: the Mantel-Haenszel ratio of rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trend import two_sided

#: Fixed value: the normal quantile of 97.5 percent.
QUANTILE = 1.959963984540054


def rate_ratios(rows: DataFrame, group: str, reference: str, stratum: str, events: str, exposure: str) -> DataFrame:
    """group, n_strata, ratio, low, high, p_value: the rate of every group against the reference group's, pooled over strata.

    rows: one row for each group and stratum. Weighted by Mantel and Haenszel; the variance of the logarithm is the one
    of Greenland and Robins for person-time. Strata in which either side is missing or has no exposure are left
    out. A ratio is null where either side has no event. The reference's rows are one a stratum; they are joined by stratum.
    """
    x, t = F.col(events).cast("double"), F.col(exposure).cast("double")
    own = rows.filter(F.col(exposure) > 0).select(F.col(group), F.col(stratum).alias("_stratum"), x.alias("_a"), t.alias("_t"))
    base = own.filter(F.col(group) == reference).select("_stratum", F.col("_a").alias("_b"), F.col("_t").alias("_u"))
    both = own.filter(F.col(group) != reference).join(base, "_stratum")
    total = F.col("_t") + F.col("_u")
    sums = both.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_strata"),
        F.sum(F.col("_a") * F.col("_u") / total).alias("_p"),
        F.sum(F.col("_b") * F.col("_t") / total).alias("_q"),
        F.sum((F.col("_a") + F.col("_b")) * F.col("_t") * F.col("_u") / (total * total)).alias("_v"),
    )
    some = (F.col("_p") > 0) & (F.col("_q") > 0)
    log, error = F.ln(F.col("_p") / F.col("_q")), F.sqrt(F.col("_v") / (F.col("_p") * F.col("_q")))
    found = sums.withColumns({"_log": F.when(some, log), "_error": F.when(some, error)})
    limit = F.lit(QUANTILE) * F.col("_error")
    return found.select(group, "n_strata", F.exp("_log").alias("ratio"), F.exp(F.col("_log") - limit).alias("low"), F.exp(F.col("_log") + limit).alias("high"), two_sided(F.col("_log") / F.col("_error")).alias("p_value"))
