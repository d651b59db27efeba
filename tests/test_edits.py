import pytest
from conftest import pairs
from pyspark.sql import functions as F

from tabsmith.operators import edits, rules
from tabsmith.operators.edits import EditRules, Merge, Replacement
from tabsmith.operators.lookup import spread_lookup

COLOGNE = Merge("Cologne", ["Koeln", "Cologne Deutz"])


def test_merge_leaves_four_cities_and_moves_the_rest(cities):
    edited = edits.apply_edits(cities, EditRules().with_merge("city", COLOGNE))
    assert edits.distinct_count(edited, "city").first()[0] == 4
    assert pairs(edits.value_counts(edited, "city"))["Cologne"] == 56
    assert pairs(edits.merge_effect(cities, "city", [COLOGNE]))["Cologne"] == 38
    assert dict(edited.dtypes)["amount"] == "double"


def test_a_source_equal_to_its_target_does_not_count(cities):
    rule = Merge("Cologne", ["Koeln", "Cologne", "nowhere"])
    assert pairs(edits.merge_effect(cities, "city", [rule])) == {"Cologne": 22}


def test_regex_counts_changes_not_matches(cities):
    rule = Replacement("Cologne.*", "Cologne", is_regex=True)
    assert edits.replacement_effect(cities, "city", rule).first()[0] == 16


def test_literal_replace_then_merge_order(cities):
    both = EditRules().with_replacement("city", Replacement(" (North)", "")).with_merge("city", Merge("Harbour", ["Porto"]))
    assert pairs(edits.value_counts(edits.apply_edits(cities, both), "city"))["Harbour"] == 62


def test_revert_brings_everything_back(cities):
    edited = EditRules().with_merge("id", Merge("zero", ["0"]))
    assert dict(edits.apply_edits(cities, edited).dtypes)["id"] == "string"
    reverted = edits.apply_edits(cities, EditRules(merges={"id": []}, replacements={"city": []}))
    assert reverted.dtypes == cities.dtypes and reverted.exceptAll(cities).isEmpty()


def test_empty_sources_are_skipped_and_the_first_rule_wins(cities):
    rule = EditRules().with_merge("city", Merge("Nothing", []), Merge("First", ["Koeln"]), Merge("Second", ["Koeln", "Porto"]))
    counts = pairs(edits.value_counts(edits.apply_edits(cities, rule), "city"))
    assert (counts["First"], counts["Second"]) == (22, 28) and "Nothing" not in counts


@pytest.mark.parametrize("inline, broadcast", [(200, 10**6), (0, 10**6), (0, 0)])
def test_merge_by_list_broadcast_and_shuffle_agree(cities, monkeypatch, inline, broadcast):
    monkeypatch.setattr(edits, "INLINE_SOURCES", inline)
    monkeypatch.setattr(edits, "BROADCAST_BYTES", broadcast)
    edited = edits.apply_edits(cities, EditRules().with_merge("city", COLOGNE))
    assert edited.columns == cities.columns
    assert pairs(edits.value_counts(edited, "city")) == {"Cologne": 56, "Porto (North)": 34, "Porto": 28, "Lyon": 32}


def test_preview_shows_both_sides(cities):
    trial = edits.apply_edits(cities, EditRules().with_merge("city", COLOGNE))
    rows = {r["value"]: (r["before"], r["after"]) for r in edits.preview_edit(cities, "city", trial).collect()}
    assert rows["Koeln"] == (22, 0) and rows["Cologne"] == (18, 56) and sum(a for _, a in rows.values()) == 150


def test_value_list_is_limited_and_ordered(cities):
    assert [r["value"] for r in edits.value_counts(cities, "city", 2).collect()] == ["Porto (North)", "Lyon"]


def test_re_accepting_a_replacement_overwrites_it():
    r = EditRules().with_replacement("c", Replacement("a", "1")).with_replacement("c", Replacement("b", "2"))
    r = r.with_replacement("c", Replacement("a", "3"))
    assert [(x.find, x.replace) for x in r.replacements["c"]] == [("b", "2"), ("a", "3")]


MERGES = "dataset string, column string, target string, source string, seq bigint, rows_affected bigint"


def test_accepting_merges_moves_sources_and_adds_up(spark):
    old = spark.createDataFrame([
        ("d", "c", "A", "a1", 1, 10), ("d", "c", "A", "a2", 1, 10), ("d", "c", "B", "b1", 2, 5), ("e", "c", "A", "a1", 1, 7)], MERGES)
    new = spark.createDataFrame([
        ("d", "c", "A", "a3", 11, 4), ("d", "c", "A", "a2", 11, 4), ("d", "c", "C", "b1", 12, 3), ("d", "c", "C", "c1", 12, 3),
        ("d", "c", "C", "c2", 13, 6)], MERGES)
    found = {tuple(r) for r in rules.add_merges(old, new).collect()}
    assert found == {
        ("d", "c", "A", "a1", 1, 14), ("d", "c", "A", "a2", 1, 14), ("d", "c", "A", "a3", 1, 14),
        ("d", "c", "C", "b1", 12, 9), ("d", "c", "C", "c1", 12, 9), ("d", "c", "C", "c2", 12, 9), ("e", "c", "A", "a1", 1, 7)}


def test_reverting_rules(spark):
    stored = spark.createDataFrame([("d", "c", "A", "a1", 1, 1), ("d", "c", "B", "b1", 2, 1), ("e", "c", "A", "a1", 1, 1)], MERGES)
    assert {(r["dataset"], r["target"]) for r in rules.revert_merge(stored, "d", "c", "A").collect()} == {("d", "B"), ("e", "A")}
    with pytest.raises(KeyError):
        rules.revert_merge(stored, "d", "c", "Z")


def test_blank_targets_and_unknown_sources_are_dropped(spark):
    groups = spark.createDataFrame(
        [("d", "c", " A ", "x"), ("d", "c", "A", "y"), ("d", "c", "  ", "x"), ("e", "c", "B", "x")],
        "dataset string, column string, target string, source string")
    values = spark.createDataFrame([("d", "c", "x"), ("d", "c", "x"), ("e", "k", "x")], "dataset string, column string, value string")
    assert [tuple(r) for r in rules.validate_groups(groups, values).collect()] == [("d", "c", "A", "x")]


def test_spread_lookup_with_heavy_and_missing_keys(spark):
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, F.col("id")).alias("k"), F.col("id").alias("v"))
    lookup = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = spread_lookup(rows, lookup, ["k"], ["v"], min_rows=100)
    assert joined.count() == 9000
    assert joined.filter("k = 0").select("n").distinct().collect()[0][0] == 3000
    assert joined.filter("k IS NULL AND n IS NULL").count() == 3000
    assert spread_lookup(rows, lookup, ["k"], ["v"], "inner", min_rows=100).count() == 6000
    plain = rows.join(lookup, "k", "left")
    assert joined.exceptAll(plain.select(joined.columns)).isEmpty()


def test_helper_names_never_take_a_users_column(spark):
    names = ["_source", "_target", "_heavy", "_salt", "_rows", "c"]
    df = spark.createDataFrame([("s", "t", "h", "l", "r", f"v{k % 300}") for k in range(900)], ", ".join(f"{n} string" for n in names))
    edited = edits.apply_edits(df, EditRules().with_merge("c", Merge("one", [f"v{k}" for k in range(250)])))
    assert edited.select(names[:5]).distinct().count() == 1 and edited.filter("c = 'one'").count() == 750
    joined = spread_lookup(df, df.groupBy("c").agg(F.count(F.lit(1)).alias("n")), ["c"], ["_salt"], min_rows=1)
    assert joined.columns == ["c", *names[:5], "n"] and joined.count() == 900


def test_value_lists_of_any_length(spark):
    df = spark.range(6000).select(F.col("id").cast("string").alias("v"))
    assert edits.value_counts(df, "v", 6000).count() == 6000


@pytest.mark.parametrize("pattern", [r"(?=a)", r"(?<!a)b", r"\1", "a++", "[[:nope:]]", "(?x)a", "[a"])
def test_patterns_without_an_equal_are_refused(pattern):
    from tabsmith.functions.text import PatternError, java_pattern

    with pytest.raises(PatternError):
        java_pattern(pattern)


@pytest.mark.parametrize("pattern, put, text", [
    ("[[:digit:]]+", "#", "ab12"), ("12$", "#", "12\n"), ("(?m)12$", "#", "12\n12"), ("(?U)a.*", "#", "ab12"), ("(?U)a.*?", "#", "ab12"),
    (r"\(?P<", "#", "x(P<"), ("[^[:space:]x]", "#", "a x\t"), (r"\s", "#", "a\x0bb c"), ("(?P<n>b)(c)", r"\2\1", "abc"), ("[a&&b]", "#", "a&b"),
    ("(?i:A)b", "#", "abAB"), ("[]a]", "#", "]a"), (r"\pL", "#", "é1"), ("a{2,3}?", "#", "aaaa"), (".", "#", "a\r\n"), (r"\Q.*\E", "#", "a.*"),
])
def test_patterns_match_as_in_duckdb(spark, pattern, put, text):
    import duckdb

    want = duckdb.execute("SELECT regexp_replace(?, ?, ?, 'g')", [text, pattern, put]).fetchone()[0]
    df = spark.createDataFrame([(text,)], "c string")
    assert edits.apply_edits(df, EditRules().with_replacement("c", Replacement(pattern, put, is_regex=True))).first()[0] == want
