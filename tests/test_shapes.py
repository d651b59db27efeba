from conftest import pairs

import pytest

from tabsmith.operators import ranges, tags
from tabsmith.operators.ranges import RangeConfig
from tabsmith.operators.tags import TagConfig

PARTLY = TagConfig(prefix_separator="-")
SPLIT_UP = {"Turin": 58, "Malmo": 51, "Basel": 43, "Oslo": 31, "Graz": 27, "Split": 26, "Ghent": 24, "Riga": 21}


def test_prefix_is_stripped(locations):
    assert pairs(tags.tag_counts(locations, "location", PARTLY)) == SPLIT_UP


def test_without_a_prefix_the_label_stays(locations):
    assert pairs(tags.tag_counts(locations, "location"))["Partly - Turin"] == 27


def test_vocabulary_and_other(locations):
    listed = ["Turin", "Basel", "Split"]
    assert pairs(tags.tag_chart(locations, "location", TagConfig("-", ",", listed))) == {t: SPLIT_UP[t] for t in listed}
    for known in (listed, [t for t in SPLIT_UP if t != "Graz"]):
        counts = pairs(tags.tag_chart(locations, "location", TagConfig("-", ",", known, include_other=True)))
        assert counts == {t: SPLIT_UP[t] for t in known} | {"Other": sum(n for t, n in SPLIT_UP.items() if t not in known)}


def test_distinct_tags_and_limit(locations):
    assert tags.tag_distinct_count(locations, "location", PARTLY).first()[0] == len(SPLIT_UP)
    assert [r[0] for r in tags.tag_counts(locations, "location", PARTLY, 3).collect()] == ["Turin", "Malmo", "Basel"]


def test_mentions_count_twice_and_nulls_never(spark):
    df = spark.createDataFrame([("a,a, ,",), (None,), ("b",)], "c string")
    assert pairs(tags.tag_counts(df, "c")) == {"a": 2, "b": 1}


def test_range_counts_and_midpoints(experience):
    config = RangeConfig(unit="km")
    assert tuple(ranges.range_parse_counts(experience, "distance_raw", config).first()) == (140, 140)
    found = {r["raw"]: r["parsed"] for r in ranges.range_preview(experience, "distance_raw", config, 140).collect()}
    assert found == {"1-3 km": 2.0, "3-5 km": 4.0, "5-9 km": 7.0, "9-13 km": 11.0, "13-22 km": 17.5}


def test_range_separator_mismatch_parses_nothing(experience):
    config = RangeConfig(separator="to", unit="km")
    assert tuple(ranges.range_parse_counts(experience, "distance_raw", config).first()) == (0, 140)


def test_range_histogram(experience):
    rows = ranges.range_histogram(experience, "distance_raw", RangeConfig(unit="km")).collect()
    assert {(r["min_val"], r["max_val"]) for r in rows} == {(2.0, 17.5)}
    assert {r["bucket"]: r["count"] for r in rows} == {0: 24, 1: 33, 3: 28, 5: 35, 9: 20}


@pytest.mark.parametrize("kind, expected", [("min", 4.0), ("max", 10.0), ("midpoint", 7.0)])
def test_range_ends(spark, kind, expected):
    df = spark.createDataFrame([("4-10 yrs-99",), ("4-10d",)], "c string")
    values = [r["parsed"] for r in ranges.range_preview(df, "c", RangeConfig("-", "yrs", kind)).collect()]
    assert values[0] == expected
    assert values[1] == (4.0 if kind == "min" else None)
