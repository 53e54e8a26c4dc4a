import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspan.functions.taxonomy import ORGANISM_GROUPS
from tallyspan.operators import calendar as cal
from tallyspan.operators.intervals import attach_points, merge_intervals
from tallyspan.operators.nested import nested_counts
from tallyspan.operators.pooled import rate_ratios
from tallyspan.operators.rules import classify_codes, first_patterns, match_patterns, numbered_patterns, resistance_labels, seed_table
from tallyspan.operators.skew import attach_points_binned, deal, hot_sides, merge_intervals_segmented
from tallyspan.plans.queries import QUERIES
from tallyspan.sources.io import export_manifest, read_sites, write_aggregate, write_sorted
from tallyspan.sources.store import release, shared_folder, stored

T0 = dt.datetime(2024, 1, 1)
STAY = "subject string, encounter string, t_in timestamp_ntz, t_out timestamp_ntz, open_end boolean"
POINT = "subject string, encounter string, t timestamp_ntz, bin int, row string"


def hours(n):
    return T0 + dt.timedelta(hours=n)


def skewed(seed, n=400):
    """Stays and points of which one key, one null key and a single instant hold very many."""
    r = random.Random(seed)
    key = lambda: r.choice([("h", "h"), ("h", "h"), (None, None), ("a", "b"), ("a", "c")])
    stays = [(*key(), hours(a := r.choice([7, r.randrange(300)])), hours(a + r.choice([1, 3, 200, 1])), r.random() < 0.1) for _ in range(n)]
    points = [(*key(), r.choice([hours(9), hours(r.randrange(500)), None]), 1, "x") for _ in range(n)]
    return stays, points


@pytest.mark.parametrize(("seed", "most"), [(1, 20), (2, 7), (3, 10_000)])
def test_segmented_merge_equals_plain(spark, seed, most):
    stays = spark.createDataFrame(skewed(seed)[0], STAY)
    columns = ["subject", "encounter", "seq", "t_in", "t_out", "any_open_end", "n_intervals"]
    rows = lambda df: Counter(tuple(r) for r in df.select(*columns).collect())
    assert rows(merge_intervals_segmented(stays, most=most)) == rows(merge_intervals(stays))


def test_segmented_merge_of_chains_and_covers(spark):
    """One stay that covers all others; a chain in which each touches the next; stays that are apart."""
    for spans in ([(0, 900)] + [(k, k + 1) for k in range(1, 300)], [(k, k + 1) for k in range(300)], [(2 * k, 2 * k + 1) for k in range(300)]):
        stays = spark.createDataFrame([("h", "h", hours(a), hours(b), False) for a, b in spans], STAY)
        got = merge_intervals_segmented(stays, most=11).select("seq", "t_in", "t_out", "n_intervals").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, merge_intervals(stays).select("seq", "t_in", "t_out", "n_intervals").collect()))
    assert merge_intervals_segmented(spark.createDataFrame([], STAY), most=1).count() == 0


@pytest.mark.parametrize(("seed", "most"), [(4, 20), (5, 6), (6, 10_000)])
def test_binned_join_equals_plain(spark, seed, most):
    stays, points = skewed(seed)
    stays, points = spark.createDataFrame(stays, STAY).drop("open_end"), spark.createDataFrame(points, POINT)
    plain, binned = attach_points(points, stays), attach_points_binned(points, stays, most=most, buckets=64)
    assert plain.columns == binned.columns
    assert Counter(map(tuple, binned.collect())) == Counter(map(tuple, plain.collect()))
    assert attach_points_binned(points.limit(0), stays, most=most).count() == attach_points_binned(points, stays.limit(0), most=most).count() == 0


def test_cells_are_bounded(spark):
    """With a third of all rows in one key, and many of them at one instant, no cell gets more than about `most` of a side."""
    most, keys = 50, ("subject", "encounter")
    r = random.Random(8)
    points = [("h", "h", hours(5 if k % 3 == 0 else r.randrange(2000)), 1, "x") for k in range(3000)] + [(str(k), str(k), hours(k), 1, "x") for k in range(100)]
    stays = [("h", "h", hours(a := r.randrange(2000)), hours(a + 2), False) for _ in range(3000)]
    points, stays = spark.createDataFrame(points, POINT), spark.createDataFrame(stays, STAY).drop("open_end")
    hot = hot_sides(points, stays, keys, "t", most, 4096)
    sides = deal(points, stays, hot, hot.count(), keys, "t", most)
    assert hot.count() == 1
    for side in sides:
        largest = side.groupBy(*keys, "_bin", "_row", "_column").count().agg(F.max("count")).first()[0]
        assert largest <= 3 * most


def test_points_of_one_time_meet_a_span_as_runs(spark):
    """The join of a hot key gets runs of points, so far fewer rows than points, in as many tasks as it has cells, whatever its bytes."""
    from tallyspan.operators import skew

    most, keys = 1000, ("subject", "encounter")
    points = spark.createDataFrame([("h", None, hours(9 + k % 2), k, None if k % 7 == 0 else "x") for k in range(3000)], POINT)
    stays = spark.createDataFrame([("h", None, hours(k % 10), hours(10), False) for k in range(2000)], STAY).drop("open_end")
    hot = hot_sides(points, stays, keys, "t", most, 64)
    own, held = deal(points, stays, hot, hot.count(), keys, "t", most)
    n_cells = own.select("_grid", "_row", "_column").distinct().count()
    pairs = skew.attach_runs(own, held, keys, "t", most)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    tree = plan.splitlines()
    assert any("Generate inline(_points" in x for x in tree) and plan.count(f", {n_cells}), REPARTITION_BY_NUM") == 2 and n_cells > 1
    runs = own.groupBy("_grid", "_row", "_column", "t", F.pmod(F.xxhash64("_number"), F.lit(-(-most // skew.RUN)))).count()
    assert runs.count() * 10 < own.count() and runs.agg(F.max("count")).first()[0] <= 2 * skew.RUN
    plain = attach_points(points, stays)
    assert Counter(map(tuple, pairs.select(*plain.columns).groupBy(*plain.columns).count().collect())) == Counter(map(tuple, plain.groupBy(*plain.columns).count().collect()))
    # Points without other columns, and without any that match.
    bare = points.select(*keys, "t")
    assert attach_points_binned(bare, stays, most=most).count() == plain.count()
    late = stays.withColumns({c: F.lit(hours(5000)).cast("timestamp_ntz") for c in ("t_in", "t_out")})
    assert attach_points_binned(points, late, most=most).count() == 0


def test_no_streamed_row_has_more_pairs_than_a_cell_has_points(spark):
    """Where a time has very many points and spans, the join of a hot key streams spans and holds short runs, so its pairs wait in small numbers."""
    from tallyspan.operators import skew

    most, keys = 500, ("subject", "encounter")
    points = spark.createDataFrame([("h", "h", hours(9), k, str(k)) for k in range(1200)], POINT)
    stays = spark.createDataFrame([("h", "h", hours(k % 9), hours(9 + k % 2), False) for k in range(1100)], STAY).drop("open_end")
    hot = hot_sides(points, stays, keys, "t", most, 64)
    own, held = deal(points, stays, hot, hot.count(), keys, "t", most)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        pairs = skew.attach_runs(own, held, keys, "t", most)
        plan = pairs._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The left side streams; the spans' columns of the cell have one underscore more.
    assert "SortMergeJoin [__grid" in plan
    largest = own.groupBy("_grid", "_row", "_column").count().agg(F.max("count")).first()[0]
    runs = own.groupBy("_grid", "_row", "_column", "t", F.pmod(F.xxhash64("_number"), F.lit(-(-most // skew.RUN)))).count()
    assert largest <= 2 * most and runs.agg(F.max("count")).first()[0] <= 80
    assert pairs.count() == attach_points(points, stays).count() == 1200 * 1100


def test_patterns(spark):
    """First by place, not by length or position; patterns of one to many characters; against every pattern."""
    r = random.Random(3)
    patterns = [("".join(r.choice("ab-c.") for _ in range(r.choice([1, 2, 3, 4, 6]))), f"g{k}") for k in range(250)] + [("", "blank"), (None, "null"), ("ZZ", "upper")]
    texts = ["".join(r.choice("abcd-. ") for _ in range(r.randrange(12))) for _ in range(300)] + [None, "", "xzzx"]
    table = spark.createDataFrame([(p, g, k) for k, (p, g) in enumerate(patterns)], "p string, g string, k int").repartition(5)
    df = spark.createDataFrame([(t, "kept", i) for i, t in enumerate(texts * 2)], "text string, group string, i int")
    got = match_patterns(df, F.col("text"), numbered_patterns(table, "p", "g", "k")).collect()
    want = {t: next(((g, k) for k, (p, g) in enumerate(patterns) if p and p.lower() in (t or "").lower()), (None, None)) for t in texts}
    assert len(got) == len(df.collect()) and all((x.group, x.place) == want[x.text] for x in got)
    assert match_patterns(df, F.col("text"), numbered_patterns(table.limit(0), "p", "g", "k")).filter("group IS NOT NULL").count() == 0
    assert match_patterns(df.limit(0), F.col("text"), numbered_patterns(table, "p", "g", "k")).count() == 0


def test_patterns_read_the_text_once(spark):
    values = spark.createDataFrame([("urine",)], "value string")
    table = numbered_patterns(spark.createDataFrame([(p, g, k) for k, (p, g) in enumerate(ORGANISM_GROUPS)], "p string, g string, k int"), "p", "g", "k")
    plan = first_patterns(values, table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and "NestedLoop" not in plan and "Cartesian" not in plan


def test_codes_exact_before_rules(spark):
    rows = [("no_growth",), ("NO_GROWTH",), ("candida auris",), (None,), ("mystery",)]
    got = {r.code: (r["class"], r.path) for r in classify_codes(spark.createDataFrame(rows, "code string"), F.col("code"), seed_table(spark)).collect()}
    assert got == {"no_growth": ("No growth/negative", "exact"), "NO_GROWTH": ("No growth/negative", "exact"), "candida auris": ("Fungi/yeast", "rule"), None: ("Other/unspecified", "default"), "mystery": ("Other/unspecified", "default")}


def test_resistance_rules_by_drug(spark):
    """Each drug has the first rule that fits organism and drug; results that aren't resistant, or of other organisms, don't count."""
    rules = [("A", "staph", "oxa|van"), ("B", "staph|entero", "van"), ("C", ".", "mero")]
    found = spark.createDataFrame([("1", "e1", "staph aureus"), ("2", "e2", "enterococcus"), ("3", "e3", "staph"), ("", "e4", "staph"), (None, "e5", "staph")], "organism_id string, event_id string, name string")
    results = [("1", "Vancomycin ", "R"), ("1", "oxacillin", "resistant"), ("1", "meropenem", "S"), ("2", "vancomycin", "Res"), ("2", "meropenem", "R"), ("3", "cefazolin", "R"), ("", "vancomycin", "R"), (None, "oxacillin", "R")]
    table = spark.createDataFrame(results * 3, "organism_id string, antimicrobial string, interpretation string")
    got = resistance_labels(found, table, F.col("name"), rules).collect()
    assert sorted((r.event_id, r.target_label) for r in got) == [("e1", "A"), ("e2", "B"), ("e2", "C")]
    assert resistance_labels(found, table.limit(0), F.col("name"), rules).count() == 0


def test_nested_counts(spark):
    r = random.Random(5)
    rows = [(r.choice("xy"), r.choice(["s", "t", None]), r.choice(["1", "2", None]), r.randrange(3)) for _ in range(200)]
    df = spark.createDataFrame(rows, "k string, subject string, encounter string, seq int")
    out = nested_counts(df, ["k"], {"n_s": ["subject"], "n_e": ["encounter"], "n_q": ["seq"]}, {"n": F.lit(1)})
    for x in out.collect():
        own = [t[1:] for t in rows if t[0] == x.k]
        assert (x.n, x.n_s, x.n_e, x.n_q) == (len(own), len({t[0] for t in own}), len({t[:2] for t in own}), len(set(own)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_no_expand_over_events(spark):
    plan = QUERIES["monthly_overall"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_rate_ratio(spark):
    """By hand: two strata, one without exposure, one that the reference lacks."""
    rows = [("r", 1, 10, 100.0), ("s", 1, 20, 100.0), ("r", 2, 5, 50.0), ("s", 2, 30, 200.0), ("s", 3, 9, 0.0), ("r", 3, 9, 10.0), ("s", 4, 9, 10.0), ("z", 1, 0, 10.0)]
    got = {x.g: x for x in rate_ratios(spark.createDataFrame(rows, "g string, k int, n int, e double"), "g", "r", "k", "n", "e").collect()}
    p, q = 20 * 100 / 200 + 30 * 50 / 250, 10 * 100 / 200 + 5 * 200 / 250
    v = 30 * 100 * 100 / 200**2 + 35 * 200 * 50 / 250**2
    se = math.sqrt(v / (p * q))
    assert got["s"].n_strata == 2 and math.isclose(got["s"].ratio, p / q) and math.isclose(got["s"].low, p / q * math.exp(-1.959963984540054 * se))
    assert math.isclose(got["s"].p_value, math.erfc(abs(math.log(p / q) / se) / math.sqrt(2)), rel_tol=1e-9)
    assert got["z"].ratio is None and got["z"].n_strata == 1


def test_a_repeated_run_replaces_its_own_rows(spark):
    path = shared_folder(spark)
    one, two = (spark.createDataFrame([(k,)], "n int") for k in (1, 2))
    write_aggregate(one, path, "a", "r1")
    write_aggregate(two, path, "b", "r1")
    write_aggregate(two, path, "a", "r2")
    write_aggregate(two.withColumn("more", F.lit("m")), path, "a", "r1")
    got = sorted((r.site_name, r.run_ts, r.n, r.more) for r in read_sites(spark, path).collect())
    assert got == [("a", "r1", 2, "m"), ("a", "r2", 2, None), ("b", "r1", 2, None)]


def test_manifest_reads_no_column(spark):
    root = shared_folder(spark)
    spark.range(5).write.parquet(f"{root}/one.parquet")
    spark.range(7).selectExpr("id", "'a,b' AS text").write.option("header", True).csv(f"{root}/deep/two.csv")
    manifest = export_manifest(spark, root, {"one.parquet": "parquet", "deep/two.csv": "csv"}, "s")
    plan = manifest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "ReadSchema: struct<>" in plan
    assert {r.dataset: (r.rows, r.columns) for r in manifest.collect()} == {"one.parquet": (5, "id"), "deep/two.csv": (7, "id; text")}


def test_sorted_files_and_places(spark):
    df = spark.range(500).selectExpr("id", "id * 7919 % 501 AS x").repartition(7)
    path = shared_folder(spark)
    write_sorted(df, path, F.desc("x"), files=5)
    files = sorted({r.f for r in spark.read.parquet(path).select(F.col("_metadata.file_path").alias("f")).collect()})
    values = [r.x for f in files for r in spark.read.parquet(f).collect()]
    assert len(files) > 1 and values == sorted(values, reverse=True)
    placed = cal.with_place(df, F.desc("x"), F.asc("id")).collect()
    assert [r.x for r in sorted(placed, key=lambda r: r.place)] == values and sorted(r.place for r in placed) == list(range(1, 501))
    assert cal.with_place(df.limit(0), F.desc("x")).count() == 0


def test_ranks_with_group_sizes(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "g string, n int")
    assert sorted(map(tuple, cal.ranked_within(df, "g", F.desc("n")).collect())) == [("a", 1, 2, 2), ("a", 3, 1, 2), ("b", 2, 1, 1)]
    assert cal.at_least(df, "n", 2).count() == 2


def test_stored_tables_are_released(spark):
    table = stored(spark.range(3))
    files = table.inputFiles()
    assert table.count() == 3 and release(spark) >= 1 and release(spark) == 0
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0])
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_rules_read_their_rows_once(spark):
    """What rules are applied to is stored narrow or as counts before, so the result's plan reads no source table again."""
    from tallyspan.plans import queries, rule_queries  # noqa: F401

    for name in ("organism_groups", "specimen_groups", "pattern_table_large", "classify_codes"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan, name


def test_texts_are_cleaned_before_the_join(spark):
    """The points' patterns run once an order and once a part: nothing above the joins with the lines cleans a text."""
    from tallyspan.plans.frames import monthly_binding, named_binding

    for binding in (monthly_binding, named_binding):
        plan = binding(spark, "/root/testdata/sf0.001").points._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_replace" not in plan.split("Join ")[0]


def test_targets_are_grouped_once(spark):
    """Texts and phenotypes of targets meet in one grouping, without a distinct of either before it; the rows stay those of the distinct ones."""
    from tallyspan.plans import queries
    from tallyspan.plans.frames import monthly_binding

    f = monthly_binding(spark, "/root/testdata/sf0.001")
    both = queries.combined(f)
    # The one other is over the resistant results.
    assert both._jdf.queryExecution().optimizedPlan().toString().count("Aggregate ") == 2
    rows = [(r.event_id, {"Ring": "R1", "Screw": "R2"}.get(r.target_label, r.target_label), r.month) for r in queries.tagged(f).collect()]
    sure = {(r.event_id, r.target_label, r.month) for r in queries.phenotypes(f).collect()}
    want = {k: "susceptibility" if k in sure else "text" for k in {*rows, *sure}}
    got = both.collect()
    assert {(r.event_id, r.target_label, r.month): r.source for r in got} == want and len(got) == len(want) > 0
    assert sum(r.n_events for r in queries.target_counts(f).collect()) == len(want)
