import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tallyspan.functions.normalize import n_distinct, negative_name, norm_sir, norm_text, norm_ts, positive_flag, rate_per, timing_bin
from tallyspan.functions.taxonomy import CLASS_CODES, classify
from tallyspan.operators import calendar as cal
from tallyspan.operators.intervals import allocate_exposure, at_risk, attach_points, fill_open_end, merge_intervals
from tallyspan.operators.quantiles import quantiles
from tallyspan.operators.trend import poisson_trend, trend_screen, two_sided
from tallyspan.plans.queries import QUERIES
from tallyspan.sources.io import export_manifest, locate, privacy_audit, read_table, write_aggregate
from tallyspan.sources.store import shared_folder

T = dt.datetime
SPAN = "subject string, encounter string, t_in timestamp_ntz, t_out timestamp_ntz, discharge timestamp_ntz, admit timestamp_ntz"


def stays(spark, rows):
    return fill_open_end(spark.createDataFrame([("a", "a", i, o, d, None) for i, o, d in rows], SPAN))


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_merge_touching_contained_open(spark):
    d = lambda n: T(2024, 1, n)
    rows = [(d(1), d(3), None), (d(3), d(5), None), (d(4), d(5), None), (d(7), None, d(9)), (d(10), None, None), (d(12), d(12), None)]
    got = sorted((r.t_in.day, r.t_out.day, r.any_open_end, r.n_intervals) for r in merge_intervals(stays(spark, rows)).collect())
    assert got == [(1, 5, False, 3), (7, 9, True, 1)]


def test_merge_of_equal_stays(spark):
    """Stays equal in both ends are never parted: both windows read one sort, so there is no tie between them."""
    d = lambda n: T(2024, 1, 1) + dt.timedelta(days=n)
    rows = [(d(3 * k), d(3 * k + 1), None) for k in range(200) for _ in range(1 + k % 4)]
    merged = merge_intervals(stays(spark, rows).repartition(7))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 2 and plan.count("Sort [") == 1
    assert sorted((r.seq, r.t_in, r.n_intervals) for r in merged.collect()) == [(k + 1, d(3 * k), 1 + k % 4) for k in range(200)]


def test_points_at_both_ends_and_null_keys(spark):
    spans = spark.createDataFrame([(None, None, T(2024, 1, 1), T(2024, 1, 2)), (None, None, T(2024, 1, 2), T(2024, 1, 3))], "subject string, encounter string, t_in timestamp_ntz, t_out timestamp_ntz")
    points = spark.createDataFrame([(None, None, T(2024, 1, 2)), (None, None, T(2024, 1, 1)), (None, None, T(2024, 1, 3, 0, 0, 1))], "subject string, encounter string, t timestamp_ntz")
    assert attach_points(points, spans).count() == 3


def test_exposure_keeps_days(spark):
    spans = spark.createDataFrame([(T(2024, 1, 30), T(2024, 3, 1)), (T(2024, 5, 1), T(2024, 6, 1))], "t_in timestamp_ntz, t_out timestamp_ntz")
    got = {r.month.month: r.days for r in allocate_exposure(spans).collect()}
    assert got == {1: 2.0, 2: 29.0, 5: 31.0}


def test_at_risk(spark):
    got = {r.day: r.n_at_risk for r in at_risk(spark.createDataFrame([(0.5,), (1.0,), (1.5,), (20.0,)], "los_days double"), 14).collect()}
    assert got[1] == 4 and got[2] == 2 and got[14] == 1


def test_normalisers(spark):
    assert one(spark, norm_text, " ICU\t") == "icu"
    assert [one(spark, norm_sir, v) for v in ("R", "res", "I", "sus", "x")] == ["resistant", "resistant", "intermediate", "susceptible", "x"]
    assert one(spark, lambda x: norm_ts(x, "string"), "03/04/2024 05:06") == T(2024, 3, 4, 5, 6)
    assert one(spark, lambda x: norm_ts(x, "bigint"), 1700000000000, "bigint") == one(spark, lambda x: norm_ts(x, "bigint"), 1700000000, "bigint")
    assert one(spark, lambda x: norm_ts(x, "string"), "junk") is None
    assert one(spark, lambda x: norm_ts(x, "string"), "2024-03-04T05:06:07Z") == one(spark, lambda x: norm_ts(x, "string"), "2024-03-04 05:06:07") == T(2024, 3, 4, 5, 6, 7)
    assert [one(spark, negative_name, v) for v in ("no growth at 5 days", "none isolated", "no x detected", "nocardia", None)] == [True, True, True, False, False]
    assert one(spark, lambda x: positive_flag(F.lit(""), x), "") is True
    assert one(spark, lambda x: positive_flag(F.lit(""), x, True), "") is False
    assert one(spark, lambda x: rate_per(x, F.lit(0)), 3, "int") is None
    assert [one(spark, lambda x: timing_bin(x)[0], v, "double") for v in (0.0, 6.0, 168.0, None)] == ["0-6 hours", "6-24 hours", "After ICU day 7", "No ICU culture"]


def test_distinct_counts_nulls(spark):
    df = spark.createDataFrame([("a", None), (None, None), ("a", None)], "x string, y string")
    r = df.agg(n_distinct("x").alias("one"), n_distinct("x", "y").alias("two")).first()
    assert (r.one, r.two) == (2, 2)


def test_classes(spark):
    assert [one(spark, classify, v) for v in ("enterobacter", "enterococcus", "candida auris", None)] == ["Gram negative bacteria", "Gram positive bacteria", "Fungi/yeast", "Other/unspecified"]


def test_complete_keeps_outside_rows(spark):
    counts = spark.createDataFrame([(dt.date(2024, 1, 1), "a", 2), (dt.date(2024, 3, 1), "a", 1), (dt.date(2025, 1, 1), "z", 9)], "month date, label string, n int")
    inside = counts.filter("label = 'a'")
    got = cal.complete(counts, cal.grid(cal.month_spine(inside), inside.select("label").distinct()), ["month", "label"], {"n": 0})
    assert sorted(r.n for r in got.collect()) == [0, 1, 2, 9]


def test_trailing_mean(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(7)], "month int, x double").withColumn("label", F.lit("a"))
    got = [r.y for r in df.withColumn("y", cal.trailing_mean("x", ["label"], "month")).orderBy("month").collect()]
    assert got[:5] == [None] * 5 and got[5:] == [2.5, 3.5]


def test_trend_of_constant_and_doubling_rates(spark):
    months = [dt.date(2020 + k // 12, k % 12 + 1, 1) for k in range(36)]
    rows = [("flat", m, 50.0, 100.0) for m in months]
    rows += [("double", m, 1000 * 2 ** ((m - months[0]).days / 30.4375 / 12), 100.0) for m in months]
    rows += [("short", m, 5.0, 10.0) for m in months[:11]] + [("none", m, 0.0, 10.0) for m in months]
    got = {r.label: r for r in poisson_trend(spark.createDataFrame(rows, "label string, month date, n double, e double"), "label", "n", "e").collect()}
    assert set(got) == {"flat", "double"}
    assert math.isclose(got["flat"].annual_ratio, 1, abs_tol=1e-6) and math.isclose(got["double"].annual_ratio, 2, rel_tol=1e-6) and got["double"].converged


def test_privacy_audit(spark):
    privacy_audit(spark.createDataFrame([("d", "month; n_events")], "dataset string, columns string"))
    with pytest.raises(PermissionError):
        privacy_audit(spark.createDataFrame([("d", "month; x_datetime")], "dataset string, columns string"))


def test_class_codes(spark):
    """Every listed code has its class, whatever the patterns would say."""
    codes = [(c, label) for label, listed in CLASS_CODES.items() for c in listed]
    df = spark.createDataFrame(codes, "code string, label string")
    assert df.filter(classify(F.col("code")) != F.col("label")).count() == 0


def test_quantiles(spark):
    shares = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    for values in ([5.0], [1.0, 2.0], [float(k * k % 97) for k in range(500)], [3.0] * 50 + [None, 1e9, -4.0]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        want = df.agg(*[F.percentile("x", F.lit(q)).alias(n) for n, q in shares.items()]).first()
        got = quantiles(df, "x", shares, buckets=7).first()
        assert all(math.isclose(got[n], want[n], abs_tol=1e-9) for n in shares)
    assert quantiles(spark.createDataFrame([(None,)], "x double"), "x", shares).first().a is None


def test_trend_directions_and_p_value(spark):
    """A rate of two levels has a known Wald test: log of the ratio over the root of the sum of inverse counts."""
    months = [dt.date(2020 + k // 12, k % 12 + 1, 1) for k in range(24)]
    rows = [("none", m, 0, 10.0) for m in months] + [("even", m, 40 + 5 * (-1) ** k, 10.0) for k, m in enumerate(months)] + [("up", m, 10 + 2 * k, 10.0) for k, m in enumerate(months)] + [("down", m, 60 - 2 * k, 10.0) for k, m in enumerate(months)]
    got = {r.label: r for r in trend_screen(spark.createDataFrame(rows, "label string, month date, n int, e double"), "label", "n", "e").collect()}
    assert {k: r.direction for k, r in got.items()} == {"none": "Not observed", "even": "No clear trend", "up": "Increasing", "down": "Decreasing"}
    t = [(m - months[0]).days / 30.4375 for m in months]
    b = math.log(got["up"].monthly_ratio)
    y = [10 + 2 * k for k in range(24)]
    a = math.log(sum(y) / sum(math.exp(b * x) for x in t))
    mu = [math.exp(a + b * x) for x in t]
    assert abs(sum((p - q) * x for p, q, x in zip(y, mu, t, strict=True))) < 1e-6
    h00, h01, h11 = sum(mu), sum(m * x for m, x in zip(mu, t, strict=True)), sum(m * x * x for m, x in zip(mu, t, strict=True))
    z = b / math.sqrt(h00 / (h00 * h11 - h01 * h01))
    assert math.isclose(got["up"].p_value, math.erfc(abs(z) / math.sqrt(2)), rel_tol=1e-6)


def test_level_order_and_unmapped(spark):
    df = spark.createDataFrame([("a", 1), ("Other", 50), ("b", 7), ("a", 2), ("c", 7), (None, 1)], "label string, n int")
    got = {r.label: r.level for r in cal.with_level(df, "label", "n").collect()}
    assert got == {"b": 1, "c": 2, "a": 3, None: 4, "Other": 5}
    assert sorted(r.label for r in cal.unmapped(df.filter("label IS NOT NULL"), "label", ["a", "Other"]).collect()) == ["b", "c"]


def test_write_locate_manifest(spark):
    root = shared_folder(spark)
    write_aggregate(spark.createDataFrame([(1, "x"), (2, None)], "n int, Label string"), f"{root}/deep/Some_Name.csv", "s", "r", "csv")
    back = read_table(spark, root, "some_name", "csv")
    assert dict(back.dtypes)["n"] == "int" and {r.label for r in back.collect()} == {"x", None} and {r.site_name for r in back.collect()} == {"s"}
    with pytest.raises(FileNotFoundError):
        locate(spark, root, "absent", "csv")
    row = export_manifest(spark, root, {"deep/Some_Name.csv": "csv"}, "s").first()
    assert row.rows == 2 and row.size_bytes > 0 and row.columns == "n; Label; care_setting; site_name; run_ts"


def test_plans_read_each_table_a_few_times(spark):
    """No query plans more than twelve scans, nor a join without keys between tables of rows."""
    for name in ("selected_series", "trend_screen_target_days", "detection_rates_five_panel_category", "monthly_overall_rates"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") <= 12, name
        assert "CartesianProduct" not in plan and "Python" not in plan, name


def test_two_sided(spark):
    values = [0.0, 1e-9, -0.5, 1.0, 1.96, -3.0, 3.53, 3.54, 6.0, -12.0, 30.0]
    got = spark.createDataFrame([(v,) for v in values], "z double").select("z", two_sided(F.col("z")).alias("p")).collect()
    assert all(math.isclose(r.p, math.erfc(abs(r.z) / math.sqrt(2)), rel_tol=1e-9) for r in got)
