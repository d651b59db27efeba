import datetime as dt
import math
import random
import statistics
from dataclasses import replace
from decimal import Decimal

import pytest
from conftest import pairs
from pyspark.sql import functions as F

from tabsmith.operators import charts, facts
from tabsmith.operators.charts import ChartFilter
from tabsmith.operators.edits import EditRules, Merge, Replacement
from tabsmith.operators.median import grouped_median
from tabsmith.operators.profile import profile
from tabsmith.operators.ranges import RangeConfig
from tabsmith.operators.tags import TagConfig
from tabsmith.plans import report
from tabsmith.plans.charts import ChartSpec, prioritized, run_chart, validate_recommendations


@pytest.fixture(scope="module")
def mixed(spark):
    plans = ["basic", "pro", "enterprise"]
    rows = [(dt.date(2024, i % 6 + 1, i % 27 + 1), 20 + i, plans[i % 3], f"a long remark, number {i}, that nobody will read twice")
            for i in range(50)]
    return spark.createDataFrame(rows, "signup_date date, age bigint, plan string, notes string").cache()


def test_histogram_counts_every_value_once(mixed):
    rows = charts.histogram(mixed, "age", 10).collect()
    assert sum(r["count"] for r in rows) == 50 and [r["bucket"] for r in rows] == list(range(10))
    ages = list(range(20, 70))
    assert rows[0]["mean"] == statistics.mean(ages) and math.isclose(rows[0]["stddev"], statistics.stdev(ages))


def test_constant_and_empty_columns(spark):
    constant = spark.createDataFrame([(5.0,)] * 4 + [(None,)], "x double")
    rows = charts.histogram(constant, "x").collect()
    assert [(r["bucket"], r["count"], r["stddev"]) for r in rows] == [(9, 4, 0.0)]
    assert charts.bell_curve(charts.histogram(constant, "x")).first()["curve"] is None
    assert charts.histogram(constant.filter("x IS NULL"), "x").count() == 0


def test_bell_curve_peaks_at_the_mean(mixed):
    rows = charts.bell_curve(charts.histogram(mixed, "age", 5), 5).collect()
    assert rows[2]["curve"] == pytest.approx(rows[2]["count"]) and rows[0]["curve"] < rows[2]["curve"]
    assert rows[0]["bin_end"] - rows[0]["bin_start"] == pytest.approx(49 / 5)


def test_bin_filters_partition_the_rows(mixed):
    parts = [charts.bin_filter("age", b, 7, 20, 69).apply(mixed).count() for b in range(7)]
    assert sum(parts) == 50 and parts == [r["count"] for r in charts.histogram(mixed, "age", 7).collect()]
    assert ChartFilter("age", lo=60, hi=69).apply(mixed).count() == 9
    assert (ChartFilter("age", hi=30).apply(mixed).count(), ChartFilter("age", lo=30).apply(mixed).count()) == (10, 40)


def test_filters_compose_with_any_chart(mixed, locations):
    line = ChartSpec("signup_date", "datetime", "line")
    assert sum(r["count"] for r in run_chart(mixed, line, ChartFilter("plan", equals="pro")).collect()) == 17
    own = ChartSpec("plan", "categorical", "pie")
    assert run_chart(mixed, own, ChartFilter("plan", equals="pro")).count() == 3
    measured = ChartSpec("plan", "categorical", "pie", measure="age", agg="avg")
    assert {"category", "value"} == set(run_chart(mixed, measured, ChartFilter("age", lo=20, hi=40)).columns)
    tagged = ChartSpec("location", "categorical", "bar", tags=TagConfig("-"))
    assert pairs(run_chart(locations, tagged, ChartFilter("amount", lo=0, hi=30)))["Turin"] == 30


def test_equality_filter_reaches_the_scan(spark, mixed, tmp_path):
    path = str(tmp_path / "m")
    mixed.write.parquet(path)
    stored = spark.read.parquet(path)
    plan = run_chart(stored, ChartSpec("plan", "categorical", "pie"), ChartFilter("age", equals="33"))._jdf.queryExecution().toString()
    assert "EqualTo(age,33)" in plan and "ReadSchema: struct<age:bigint,plan:string>" in plan
    assert ChartFilter("age", equals="abc").apply(stored).count() == 0


def test_filter_on_a_merged_value_reaches_the_scan(spark, mixed, tmp_path):
    path = str(tmp_path / "m")
    mixed.write.parquet(path)
    stored, spec = spark.read.parquet(path), ChartSpec("signup_date", "datetime", "line", grain="year")
    merged = EditRules().with_merge("plan", Merge("paid", ["pro", "enterprise"]), Merge("basic", ["free"]))
    counts = {}
    for value in ("paid", "basic", "pro"):
        chart = run_chart(stored, spec, ChartFilter("plan", equals=value), edits=merged)
        counts[value] = sum(r["count"] for r in chart.collect())
    assert counts == {"paid": 33, "basic": 17, "pro": 0}
    chart = run_chart(stored, spec, ChartFilter("plan", equals="paid"), edits=merged)
    assert "In(plan, [enterprise,paid,pro])" in chart._jdf.queryExecution().toString()
    replaced = merged.with_replacement("plan", Replacement("basic", "pro"))
    assert sum(r["count"] for r in run_chart(stored, spec, ChartFilter("plan", equals="paid"), edits=replaced).collect()) == 50


def test_measures(spark):
    rows = [(["north", "south", "west"][i % 3], 51 * i + 7) for i in range(33)]
    df = spark.createDataFrame(rows, "region string, visits bigint")
    for agg, of in (("avg", statistics.mean), ("median", statistics.median), ("sum", sum), ("count", len)):
        found = pairs(charts.measure_by(df, "region", "visits", agg))
        assert found == {c: of([v for k, v in rows if k == c]) for c in ("north", "south", "west")}
    assert [r["category"] for r in charts.measure_by(df, "region", "visits").collect()] == ["west", "south", "north"]


@pytest.mark.parametrize("slice_rows", [10**6, 100, 7, 1])
def test_median_in_slices_matches_brute_force(spark, slice_rows):
    random.seed(3)
    # One group holds a third of the rows, one value a third of that.
    rows = [("hot" if i % 3 == 0 else f"g{i % 40}", 0.0 if i % 9 == 0 else round(random.lognormvariate(0, 3), 2)) for i in range(4000)]
    rows += [("single", 4.0), ("pair", 1.0), ("pair", 2.0), ("none", None)]
    found = pairs(grouped_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", slice_rows))
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert found == {k: pytest.approx(statistics.median(v)) for k, v in groups.items()}


def test_shares(spark):
    counts = spark.createDataFrame([("basic", 40), ("pro", 8), ("enterprise", 2)], "category string, count bigint")
    assert {r["category"]: r["share"] for r in charts.with_share(counts).collect()} == {"basic": 80.0, "pro": 16.0, "enterprise": 4.0}
    found = facts.chart_facts(counts, "categorical").collect()
    assert [(r["fact"], r["subject"], r["number"]) for r in found] == [
        ("largest", "basic", 40.0), ("largest_share", "basic", 80.0), ("smallest", "enterprise", 2.0)]
    assert facts.chart_facts(counts.limit(1), "categorical").first()["fact"] == "too_sparse"


def test_fingerprint_ignores_row_order_and_sees_changes(spark):
    rows = [("a", 1), ("b", 2), (None, 3)]
    print_ = lambda r, kind="pie": facts.result_fingerprint(
        spark.createDataFrame(r, "category string, count bigint"), "c", kind, "categorical").first()[0]
    assert print_(rows) == print_(rows[::-1])
    assert len({print_(rows), print_(rows[:2]), print_([("a", 2), ("b", 1), (None, 3)]), print_(rows, "bar")}) == 4


def test_recommendations(spark, mixed):
    found = report.recommend_charts(profile(mixed), report.numeric_shape(mixed))
    chosen = {r["column"]: (r["partition_type"], r["chart_type"]) for r in found.collect()}
    assert chosen == {"signup_date": ("datetime", "line"), "age": ("numerical_bins", "bell_curve"), "plan": ("categorical", "pie")}
    assert [s.column for s in report.chart_specs(found)] == ["signup_date", "age", "plan"]


def test_skewed_and_zero_based_numbers_get_a_histogram(spark):
    df = spark.range(1000).select(F.exp(F.col("id") / 100).alias("skewed"), (F.col("id") % 500).cast("double").alias("from_zero"))
    found = report.recommend_charts(profile(df), report.numeric_shape(df))
    assert {r["chart_type"] for r in found.collect()} == {"histogram"}


def test_nothing_chartable(spark):
    rows = [(f"row-{i}-{'x' * 50}", f"comment {i} {'y' * 60}") for i in range(10)]
    found = report.recommend_charts(profile(spark.createDataFrame(rows, "id_text string, comment string")))
    assert report.chart_specs(found) == [] and report.auto_report(None, []) == {}


def test_a_failing_chart_does_not_sink_the_report(mixed):
    specs = [ChartSpec("plan", "categorical", "pie", id="ok"), ChartSpec("gone", "categorical", "bar", id="bad")]
    out = report.auto_report(mixed, specs)
    assert isinstance(out["bad"], Exception) and out["ok"].count() == 3
    late = report.auto_report(mixed, [ChartSpec("plan", "categorical", "bar", measure="notes", agg="avg", id="late"), specs[0]])
    assert isinstance(late["late"], Exception) and late["ok"].count() == 3
    assert report.report_counts(mixed, []).count() == 0
    with pytest.raises(ValueError, match="late"):
        report.report_counts(mixed, [ChartSpec("plan", "categorical", "bar", measure="age", id="late")])
    kept = report.regenerate([ChartSpec("plan", "categorical", "bar", source="custom"), specs[0]], specs[:1])
    assert [s.source for s in kept] == ["auto", "custom"]


def test_long_report_equals_single_charts(mixed):
    specs = report.chart_specs(report.recommend_charts(profile(mixed)))
    long = {(r["chart_id"], r["key"]): r["count"] for r in report.report_counts(mixed, specs).collect()}
    singles = {}
    for s in specs:
        for r in s.apply(mixed).collect():
            key = r["period"].strftime("%Y-%m-%d") if s.partition_type == "datetime" else str(r[0])
            singles[(s.id, key)] = r["count"]
    assert long == singles


def test_bad_recommendations_are_dropped(spark):
    known = spark.createDataFrame([("d", "a")], "dataset string, name string")
    proposed = spark.createDataFrame([
        ("d", "a", "categorical", "pie", "T", "SELECT 1", 0), ("d", "b", "categorical", "pie", "T", "SELECT 1", 1),
        ("d", "a", "geo", "pie", "T", "SELECT 1", 2), ("d", "a", "categorical", "radar", "T", "SELECT 1", 3),
        ("d", "a", "categorical", "pie", " ", "SELECT 1", 4), ("d", "a", "categorical", "pie", "T", None, 5),
        ("d", "a", "datetime", "line", "T", "SELECT 1", 6)],
        "dataset string, column string, partition_type string, chart_type string, title string, sql string, position int")
    valid = validate_recommendations(proposed, known)
    assert [r["position"] for r in prioritized(valid).collect()] == [6, 0]


def stages(spark):
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm
    found = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return [found.apply(k) for k in range(found.size())]


def test_a_mixed_report_takes_two_scans(spark, tmp_path):
    """Each chart is what it is by itself; the table is read twice, failing charts or cached tables aside."""
    rows = [(k, f"b{k % 7}" if k % 11 else None, f"x, y{k % 3}, {'é' * (k % 2)}", f"{k % 9}-{k % 9 + 4} km", k * 1.25 if k % 5 else None, Decimal(k) / 4,
             dt.date(2024, 1, 1) + dt.timedelta(days=k % 400), k % 2 == 0, float("nan") if k == 3 else -0.0 if k == 4 else float(k % 13)) for k in range(1000)]
    schema = "id long, brand string, tags string, span string, x double, price decimal(12,2), day date, flag boolean, odd double"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    vocabulary = TagConfig(vocabulary=("x", "y1"), include_other=True)
    specs = [
        ChartSpec("brand", "categorical", "bar"), ChartSpec("flag", "categorical", "pie"), ChartSpec("price", "categorical", "bar"),
        ChartSpec("odd", "categorical", "bar"), ChartSpec("day", "datetime", "line"), ChartSpec("day", "datetime", "line", grain="week"),
        ChartSpec("x", "numerical_bins", "histogram"), ChartSpec("id", "numerical_bins", "bell_curve", bins=8),
        ChartSpec("tags", "categorical", "bar", tags=TagConfig()), ChartSpec("tags", "categorical", "bar", tags=vocabulary),
        ChartSpec("span", "numerical_bins", "histogram", range=RangeConfig(unit="km")),
        *[ChartSpec("brand", "categorical", "bar", measure=m, agg=a) for m, a in (("x", "avg"), ("price", "sum"), ("id", "sum"), ("day", "count"), ("price", "avg"))],
        ChartSpec("day", "datetime", "line", measure="id", agg="avg"), ChartSpec("id", "numerical_bins", "bar", measure="x", agg="sum", bins=5),
    ]
    specs = [replace(s, id=f"{k}:{s.column}") for k, s in enumerate(specs)]
    known = {s.stageId() for s in stages(spark)}
    made = report.auto_report(df, specs)
    assert sum(s.inputRecords() for s in stages(spark) if s.stageId() not in known) <= 2 * df.count()
    assert not any(v.is_cached for v in made.values())
    rounded = lambda rows: [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows]
    for s in specs:
        got, want = made[s.id], s.apply(df)
        assert got.schema.simpleString() == want.schema.simpleString(), s
        assert repr(rounded(got.collect())) == repr(rounded(want.collect())), s


def test_failing_and_median_charts_in_a_mixed_report(mixed):
    wrong = [ChartSpec("plan", "categorical", "bar", measure="notes", agg="avg", id=f"bad{k}") for k in range(2)]
    right = [ChartSpec("plan", "categorical", "bar", id=f"ok{k}") for k in range(5)]
    medians = [ChartSpec("plan", "categorical", "bar", measure="age", agg="median", id="median"), ChartSpec("gone", "categorical", "bar", measure="age", agg="median", id="gone")]
    made = report.auto_report(mixed, [right[0], wrong[0], *right[1:3], *medians, wrong[1], *right[3:]])
    assert {k for k, v in made.items() if isinstance(v, Exception)} == {"bad0", "bad1", "gone"}
    assert all(made[s.id].collect() == s.apply(mixed).collect() for s in [*right, medians[0]])
    assert report.auto_report(mixed.limit(0), right[:1])["ok0"].count() == 0
