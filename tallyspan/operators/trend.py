"""Grouped log-linear Poisson trend with a log-exposure offset, as one Spark job for all groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTH_DAYS, NEWTON_STEPS, LEAST_MONTHS = 30.4375, 25, 12

#: One Newton step on (a, b) over the array `series` of (t, y, e): sums of score and information, then a 2 x 2 solve.
_SUMS = """aggregate(series, struct(0D AS g0, 0D AS g1, 0D AS h00, 0D AS h01, 0D AS h11),
  (s, x) -> struct(s.g0 + x.y - x.e * exp({a} + {b} * x.t) AS g0, s.g1 + x.t * (x.y - x.e * exp({a} + {b} * x.t)) AS g1,
    s.h00 + x.e * exp({a} + {b} * x.t) AS h00, s.h01 + x.t * x.e * exp({a} + {b} * x.t) AS h01, s.h11 + x.t * x.t * x.e * exp({a} + {b} * x.t) AS h11))"""


def two_sided(z: Column) -> Column:
    """The normal tail probability beyond |z| on either side: a power series near 0, a continued fraction further out."""
    w = F.abs(z) / math.sqrt(2)
    start = F.struct(w.alias("t"), w.alias("s"))

    def term(acc: Column, k: Column) -> Column:
        t = acc["t"] * 2.0 * w * w / (2 * k + 3).cast("double")
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    near = 1 - 2 / math.sqrt(math.pi) * F.exp(-w * w) * F.aggregate(F.sequence(F.lit(0), F.lit(80)), start, term, lambda acc: acc["s"])
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), w, lambda f, k: w + k.cast("double") / 2.0 / f)
    return F.when(w < 2.5, near).otherwise(F.exp(-w * w) / (math.sqrt(math.pi) * fraction))


def poisson_trend(monthly: DataFrame, label: str, n: str, exposure: str) -> DataFrame:
    """label, monthly_ratio, annual_ratio, annual_percent_change, p_value, converged.

    Months without exposure are left out; groups of fewer than 12 months or without events are not fitted.
    """
    rows = monthly.filter(F.col(exposure) > 0).select(label, "month", F.col(n).cast("double").alias("y"), F.col(exposure).cast("double").alias("e"))
    series = rows.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("month", "y", "e"))).alias("m"), F.sum("y").alias("total"), F.sum("e").alias("exposed"))
    series = series.filter((F.size("m") >= LEAST_MONTHS) & (F.col("total") > 0))
    series = series.withColumn("series", F.expr(f"transform(m, x -> struct(datediff(x.month, m[0].month) / {MONTH_DAYS}D AS t, x.y AS y, x.e AS e))"))
    sums = _SUMS.format(a="p.a", b="p.b")
    det = "(s.h00 * s.h11 - s.h01 * s.h01)"
    solve = f"transform(array({sums}), s -> struct(p.a + coalesce(try_divide(s.h11 * s.g0 - s.h01 * s.g1, {det}), 0D) AS a, p.b + coalesce(try_divide(s.h00 * s.g1 - s.h01 * s.g0, {det}), 0D) AS b, abs(coalesce(try_divide(s.h00 * s.g1 - s.h01 * s.g0, {det}), 0D)) AS move))[0]"
    fitted = series.withColumn("fit", F.expr(f"aggregate(sequence(1, {NEWTON_STEPS}), struct(ln(total / exposed) AS a, 0D AS b, 1D AS move), (p, i) -> {solve})"))
    s = _SUMS.format(a="fit.a", b="fit.b")
    fitted = fitted.withColumn("s", F.expr(s)).withColumn("se", F.expr(f"sqrt(try_divide(s.h00, {det}))"))
    annual = F.exp(12 * F.col("fit.b"))
    return fitted.select(label, F.exp("fit.b").alias("monthly_ratio"), annual.alias("annual_ratio"), (100 * (annual - 1)).alias("annual_percent_change"), two_sided(F.try_divide("fit.b", "se")).alias("p_value"), (F.col("fit.move") < 1e-8).alias("converged"))


def trend_screen(monthly: DataFrame, label: str, n: str, exposure: str) -> DataFrame:
    """The trend of every label with its total, first and last month with events, mean rate and direction."""
    rate = F.try_divide(100.0 * F.col(n), F.col(exposure))
    seen = F.when(F.col(n) > 0, F.col("month"))
    facts = monthly.withColumn("rate", rate).groupBy(label).agg(F.sum(n).alias("total"), F.min(seen).alias("first_month"), F.max(seen).alias("last_month"), F.avg("rate").alias("mean_rate"), F.max("rate").alias("max_rate"))
    out = facts.join(poisson_trend(monthly, label, n, exposure), label, "left")
    change, sure = F.col("annual_percent_change"), F.col("p_value") < 0.05
    direction = F.when(F.col("total") == 0, "Not observed").when(change.isNull() | F.col("p_value").isNull(), "Not estimated")
    return out.withColumn("direction", direction.when(sure & (change > 0), "Increasing").when(sure & (change < 0), "Decreasing").otherwise("No clear trend"))
