import pytest
from pyspark.sql import functions as F

from tabsmith.operators import sketches
from tabsmith.operators.overrides import apply_overrides, overlay_configs, review_queue
from tabsmith.operators.profile import classify, column_counts, dataset_health, dataset_summary, profile


def by_name(df):
    return {r["name"]: r for r in df.collect()}


@pytest.mark.parametrize("type_, rows, distinct, length, name, category, confidence", [
    ("DATE", 10, 5, None, "d", "datetime", 99.0),
    ("timestamp_ntz", 10, 5, None, "d", "datetime", 99.0),
    ("TIMESTAMP WITH TIME ZONE", 10, 5, None, "d", "datetime", 99.0),
    ("BOOLEAN", 10, 2, None, "b", "categorical", 99.0),
    ("BIGINT", 100, 5, None, "rating", "categorical", 89.2),
    ("BIGINT", 100, 7, None, "n", "categorical", 85.3),
    ("BIGINT", 100, 20, None, "n", "categorical", 60.0),
    ("BIGINT", 100, 21, None, "n", "continuous_numerical", 62.0),
    ("DECIMAL(18,2)", 1000, 500, None, "amount", "continuous_numerical", 99.0),
    ("BIGINT", 1000, 900, None, "room_code", "categorical", 65.0),
    ("bigint", 100, 5, None, "room_code", "categorical", 89.2),
    ("VARCHAR", 0, 0, None, "t", "categorical", 50.0),
    ("VARCHAR", 5000, 65, 12.0, "boat_class", "categorical", 88.9),
    ("VARCHAR", 100, 60, 55.0, "notes", "free_text", 85.0),
    ("VARCHAR", 50, 50, 10.0, "code", "free_text", 99.0),
    ("string", 100, 30, 10.0, "city", "categorical", 55.0),
])
def test_classification(spark, type_, rows, distinct, length, name, category, confidence):
    stats = spark.createDataFrame([(name, type_, rows, 0, distinct, length)],
                                  "name string, type string, row_count bigint, null_count bigint, distinct_count bigint, avg_length double")
    row = classify(stats).first()
    assert (row["category"], row["confidence"]) == (category, confidence)
    assert row["needs_review"] == (confidence < 70)


@pytest.mark.parametrize("rows, nulls", [(100, 0), (100, 25), (0, 0), (4, 1), (400, 151), (400, 1), (2000, 3)])
def test_health(spark, rows, nulls):
    health = round((1 - nulls / rows) * 100, 1) if rows else 0.0
    missing = round(nulls / rows * 100, 1) if rows else 0.0
    stats = spark.createDataFrame([("c", "bigint", rows, nulls, 1, None)],
                                  "name string, type string, row_count bigint, null_count bigint, distinct_count bigint, avg_length double")
    row = classify(stats).first()
    assert (row["health_score"], row["null_percentage"]) == (health, missing)


def test_dataset_health(spark):
    assert dataset_health(spark.createDataFrame([(100.0,), (50.0,)], "health_score double")).first()[0] == 75.0
    assert dataset_health(spark.createDataFrame([], "health_score double")).first()[0] == 100.0


def test_profile_fixture(spark):
    df = spark.createDataFrame([(i, "moored", f"mast {i}") for i in range(1, 31)], "boat_id bigint, state string, notes string")
    found = by_name(profile(df))
    assert (found["boat_id"]["category"], found["boat_id"]["needs_review"], found["boat_id"]["alias"]) == ("categorical", True, "Boat ID")
    assert (found["state"]["category"], found["state"]["alias"]) == ("categorical", "State")
    assert found["notes"]["category"] == "free_text"


def test_only_the_boundary_column_needs_review(spark):
    df = spark.createDataFrame([(i, (i % 20) + 1, "x") for i in range(50)], "row_num bigint, code bigint, label string")
    assert [r["name"] for r in review_queue(profile(df)).collect()] == ["code"]


def test_empty_table_keeps_a_row_per_column(spark):
    found = by_name(profile(spark.createDataFrame([], "a bigint, b string")))
    assert (found["b"]["category"], found["b"]["confidence"], found["a"]["row_count"]) == ("categorical", 50.0, 0)


def test_all_types_and_odd_names(spark):
    df = spark.sql("""
        SELECT id, id % 2 = 0 AS flag, CAST(id AS DECIMAL(10,2)) AS `dec.imal`, array(id) AS list, map('k', id) AS m,
               CAST(CAST(id AS STRING) AS BINARY) AS bin, CASE WHEN id = 0 THEN -0.0D WHEN id = 1 THEN 0.0D ELSE double('nan') END AS z,
               timestamp_micros(id) AS ts, DATE'2024-01-01' AS `we``ird`, CAST(NULL AS STRING) AS empty
        FROM range(10)""")
    found = by_name(profile(df))
    expected = {"id": 10, "flag": 2, "dec.imal": 10, "list": 10, "m": 10, "bin": 10, "z": 2, "ts": 10, "we`ird": 1, "empty": 0}
    assert {n: r["distinct_count"] for n, r in found.items()} == expected
    assert found["list"]["avg_length"] is None and found["empty"]["null_count"] == 10


def test_long_texts_are_counted_whole(spark):
    base = "x" * 5000
    df = spark.createDataFrame([(base + "a",), (base + "b",), (base + "b",), ("short",), (None,)], "t string")
    row = profile(df).first()
    assert (row["distinct_count"], row["null_count"], row["avg_length"]) == (3, 1, (5001 * 3 + 5) / 4)


@pytest.mark.parametrize("values, separator", [
    (["oak, elm", "ash, fir, yew", "lime", "larch, oak"], ","),
    (["oak, elm", "ash", "fir", "yew", "lime"], None), ([], None), (["a|b", "c|d", "e"], "|"), (["a;", ";b", "; ;"], None),
])
def test_multi_value_hint(spark, values, separator):
    # Ten copies of each, so that the column counts as categorical.
    df = spark.createDataFrame([(v,) for v in values for _ in range(100)], "c string")
    assert profile(df).first()["multi_value_separator"] == separator


@pytest.mark.parametrize("values, hint", [
    (["7-9 kg", "1-12 kg", "20-35 kg", "3-6 kg"], ("-", "kg")), (["7.25-8.5", "6-9", "0.1-0.9"], ("-", None)),
    (["8", "21", "40"], (None, None)), (["1-2 km", "2-3 mi", "3-4 mi", "x"], ("-", "mi")), (["1-2 b", "2-3 a"], ("-", "a")),
])
def test_range_hint(spark, values, hint):
    row = profile(spark.createDataFrame([(v,) for v in values], "c string")).first()
    assert (row["range_separator"], row["range_unit"]) == hint


def test_estimated_profile_agrees_where_it_matters(spark, locations, experience):
    for df in (locations, experience):
        exact, estimated = by_name(profile(df)), by_name(profile(df, exact=False))
        for name, row in exact.items():
            other = estimated[name]
            for c in ("category", "row_count", "null_count", "avg_length", "multi_value_separator", "range_separator", "range_unit"):
                assert other[c] == row[c], (name, c)


def test_one_value_filling_a_column_and_catalog_profiles(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 5)).alias("ds"),
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("v"),
    )
    found = {r["dataset"]: r for r in column_counts(df, by="ds").collect()}
    assert found["hot"]["distinct_count"] == 1 and found["hot"]["row_count"] == 1000
    assert sum(r["distinct_count"] for d, r in found.items() if d != "hot") == 2000
    assert dataset_summary(profile(df, by="ds")).count() == 6


PROFILE = ("dataset string, name string, alias string, category string, category_source string, confidence double, "
           "needs_review boolean, rationale string, multi_value_separator string, range_separator string, range_unit string")
OVERRIDE = "dataset string, name string, source string, category string, confidence double, rationale string, alias string"


def test_overrides(spark):
    base = spark.createDataFrame(
        [("d", n, n.upper(), "categorical", "rule", 60.0, True, None, None, None, None) for n in "abcdef"], PROFILE)
    changes = spark.createDataFrame([
        ("d", "a", "ai", "free_text", 90.0, "prose", None), ("d", "b", "ai", "nonsense", 90.0, "x", None),
        ("d", "c", "user", "datetime", None, None, None), ("d", "d", "user", None, None, None, "Label"),
        ("d", "e", "ai", "categorical", 50.0, None, None), ("other", "f", "user", "datetime", None, None, None)], OVERRIDE)
    found = by_name(apply_overrides(base, changes))
    state = {n: (r["category"], r["category_source"], r["confidence"], r["needs_review"], r["rationale"], r["alias"]) for n, r in found.items()}
    assert state == {
        "a": ("free_text", "ai", 90.0, False, "prose", "A"), "b": ("categorical", "rule", 60.0, True, None, "B"),
        "c": ("datetime", "user", 100.0, False, None, "C"), "d": ("categorical", "rule", 60.0, True, None, "Label"),
        "e": ("categorical", "ai", 50.0, True, None, "E"), "f": ("categorical", "rule", 60.0, True, None, "F")}
    assert review_queue(base, ["b"]).count() == 1
    assert review_queue(base, spark.createDataFrame([("d", "a"), ("x", "b")], "dataset string, name string")).count() == 1


def test_saved_configs_win(spark):
    base = spark.createDataFrame(
        [("d", n, n, "categorical", "rule", 90.0, False, None, "|", "-", "yrs") for n in "ab"], PROFILE)
    tags = spark.createDataFrame([("d", "a", "")], "dataset string, name string, tag_separator string")
    spans = spark.createDataFrame([("d", "b", None, None)], "dataset string, name string, separator string, unit string")
    found = by_name(overlay_configs(base, tags, spans))
    assert (found["a"]["multi_value_separator"], found["a"]["range_unit"]) == (",", "yrs")
    assert (found["b"]["multi_value_separator"], found["b"]["range_separator"], found["b"]["range_unit"]) == ("|", "-", None)


def test_states_of_parts_give_the_profile_of_the_whole(spark, tmp_path):
    """Appended parts, merged or compacted, equal one state of all rows; counts equal the exact profile's."""
    rows = [(k, None if k % 5 == 0 else f"v{k % 30}", f"{k % 9}-{k % 9 + 4} {'km' if k % 3 else 'mi'}", k / 8 if k % 2 else None, f"a, b{k % 4}", "x" if k % 4 else None, "é'\\" * 200 + str(k))
            for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, `odd'na\\me` string, span string, x double, tags string, team string, long string")
    plain = ["dataset", "name", "type", "category", "row_count", "null_count", "avg_length", "multi_value_separator", "range_separator", "range_unit"]
    for by in (None, "team"):
        folder = str(tmp_path / f"states-{by}")
        for part in range(3):
            sketches.append_states(df.filter(F.col("id") % 3 == part), folder, by=by)
        stored = spark.read.parquet(folder)
        known = sorted(map(repr, sketches.estimated_profile(stored).drop("distinct_count").collect()))
        assert known == sorted(map(repr, sketches.estimated_profile(sketches.column_states(df, by=by)).drop("distinct_count").collect()))
        sketches.compact_states(spark, folder, folder + "-compact")
        assert sorted(map(repr, sketches.estimated_profile(spark.read.parquet(folder + "-compact")).collect())) == sorted(
            map(repr, sketches.estimated_profile(stored).collect()))
        exact = {(r["dataset"], r["name"]): r for r in profile(df, by=by).collect()}
        got = {(r["dataset"], r["name"]): r for r in sketches.estimated_profile(stored).collect()}
        assert got.keys() == exact.keys() and len(got) == (7 if by is None else 12)
        for key, r in got.items():
            assert [r[c] for c in plain] == [exact[key][c] for c in plain], key
            assert abs(r["distinct_count"] - exact[key]["distinct_count"]) <= exact[key]["distinct_count"] * sketches.ERROR_BOUND


def test_inexact_profiles_by_dataset_are_estimates(spark):
    df = spark.range(20000).selectExpr("id DIV 4 AS n", "CAST(id % 2 AS STRING) AS half")
    found = {r["dataset"]: r["distinct_count"] for r in profile(df, by="half", exact=False).collect()}
    assert all(n != 5000 and abs(n - 5000) <= 5000 * sketches.ERROR_BOUND for n in found.values())
    assert {r["distinct_count"] for r in profile(df, by="half").collect()} == {5000}
