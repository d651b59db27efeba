import math

import pytest
from pyspark.sql import functions as F

from tabsmith.operators import inverse
from tabsmith.operators.charts import ChartFilter
from tabsmith.operators.edits import EditRules, Merge, Replacement, apply_edits
from tabsmith.plans.charts import ChartSpec, run_chart

RULES = EditRules().with_replacement("city", Replacement(r"^Cologne.*", "Koeln", is_regex=True)).with_merge(
    "city", Merge("West", ["Koeln"]))
NUMBERS = [0.0, -0.0, 1.5, 1e7, 1e-7, 2.5e17, math.nan, math.inf, -math.inf, None, 12.0, 120.25]


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("limit", [0, 2, 1000])
@pytest.mark.parametrize("wanted", ["West", "Koeln", "Porto (North)", "nowhere"])
def test_filter_equals_filter_on_edited_text(spark, cities, limit, wanted):
    known = inverse.value_dictionary(cities, "city")
    got = inverse.filter_edited(cities, RULES, "city", lambda t: t == wanted, known, limit)
    assert rows(got) == rows(apply_edits(cities, RULES).filter(F.col("city") == wanted))


@pytest.mark.parametrize("limit", [1, 1000])
@pytest.mark.parametrize("data_type", ["double", "float", "decimal(30,8)", "string"])
@pytest.mark.parametrize("form", ["-0,0", "0,0", "nan", "any"])
def test_numbers_signs_nan_and_null(spark, limit, data_type, form):
    values = spark.createDataFrame([(v, i) for v in NUMBERS for i in (1, 2)], "`a.b` double, _value int")
    df = values.withColumn("a.b", F.col("`a.b`").try_cast(data_type))
    rules = EditRules().with_replacement("a.b", Replacement(".", ","))
    wanted = {"null": lambda t: t.isNull(), "any": lambda t: t.isNull() | (F.length(t) > 2), "nan": lambda t: F.lower(t) == "nan"}.get(form, lambda t: t == form)
    got = inverse.filter_edited(df, rules, "a.b", wanted, inverse.value_dictionary(df, "a.b"), limit)
    assert rows(got) == rows(apply_edits(df, rules).filter(wanted(F.col("`a.b`"))))


def test_stored_dictionary_puts_the_list_into_the_scan(spark, cities, tmp_path):
    cities.write.parquet(str(tmp_path / "data"))
    stored = spark.read.parquet(str(tmp_path / "data"))
    path = inverse.write_dictionaries(stored, ["city", "amount"], str(tmp_path / "known"))
    known = {"city": inverse.open_dictionary(spark, path, "city")}
    assert known["city"].agg(F.sum("rows")).first()[0] == 150
    chart = run_chart(stored, ChartSpec("notes", "categorical", "bar"), ChartFilter("city", equals="West"), edits=RULES, dictionaries=known)
    plan = chart._jdf.queryExecution().executedPlan().toString()
    assert "In(city, [" in plan.split("PushedFilters")[1]
    assert chart.agg(F.sum("count")).first()[0] == 22 + 18 + 16
    ranged = run_chart(stored, ChartSpec("notes", "categorical", "bar"), ChartFilter("amount", lo=0, hi=1), edits=RULES, dictionaries=known)
    assert ranged.count() == stored.filter("amount >= 0 and amount < 1").count()


def test_empty_table_has_an_empty_dictionary(spark, cities):
    none = cities.limit(0)
    assert inverse.filter_edited(none, RULES, "city", lambda t: t == "West", inverse.value_dictionary(none, "city")).count() == 0
