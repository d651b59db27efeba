import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions import (
    alias_of, as_text, literal_split, looks_like_identifier, looks_like_money, non_blank_tokens, parse_date,
    parse_numeric_string, regex_replace_all, round_tenths, to_double,
)


def each(spark, values, sql_type, expression):
    df = spark.createDataFrame([(v,) for v in values], f"v {sql_type}")
    return [r[0] for r in df.select(expression(F.col("v"))).collect()]


def test_round_tenths_is_correct_rounding_of_the_binary_value(spark):
    random.seed(1)
    values = [60 + k / 20 * 39 for k in range(21)] + [i / 2000 * 100 for i in range(2001)] + [62.25, 0.25, -0.25, -0.75, 85.35]
    values += [random.uniform(-200, 200) for _ in range(500)]
    assert each(spark, values, "double", round_tenths) == [round(v, 1) for v in values]
    assert each(spark, [0.25, 0.75, 12.5], "double", lambda c: round_tenths(c, "up")) == [0.3, 0.8, 12.5]


@pytest.mark.parametrize("text, expected", [
    ("2024-01-05", dt.date(2024, 1, 5)), ("01/15/2024", dt.date(2024, 1, 15)), ("15/01/2024", dt.date(2024, 1, 15)),
    ("2024/2/3", dt.date(2024, 2, 3)), ("2-3-2024", dt.date(2024, 2, 3)), ("30-3-2024", dt.date(2024, 3, 30)),
    ("March 3, 2024", dt.date(2024, 3, 3)), ("mar 3, 2024", dt.date(2024, 3, 3)), (" 2024-1-5 ", dt.date(2024, 1, 5)),
    ("2024-01-05 10:11:12", dt.date(2024, 1, 5)), ("5-Apr-2024", None), ("2023-02-30", None), ("24-01-05", None), ("x", None),
])
def test_parse_date(spark, text, expected):
    assert each(spark, [text], "string", parse_date) == [expected]


def test_parse_date_day_first(spark):
    assert each(spark, ["2/3/2024"], "string", lambda c: parse_date(c, day_first=True)) == [dt.date(2024, 3, 2)]


def test_numbers(spark):
    texts = ["$1,037.50", "5%", "-$ 3", "1d", "abc", " 7 ", "1e3", "inf", None]
    assert each(spark, texts, "string", parse_numeric_string) == [1037.5, 5.0, None, None, None, 7.0, 1000.0, None, None]
    assert each(spark, ["1f", "2.", ".5", "+4"], "string", to_double) == [None, 2.0, 0.5, 4.0]
    assert each(spark, ["$1,037.50", "0%", "1,0", "x"], "string", looks_like_money) == [True, True, False, False]


def test_text_of_doubles(spark):
    values = [1e7, 123456789.125, 1e15, 1e16, 1e-4, 1e-5, -2.5e-7, 3.0, 1e100]
    expected = ["10000000.0", "123456789.125", "1000000000000000.0", "1e+16", "0.0001", "1e-05", "-2.5e-07", "3.0", "1e+100"]
    assert each(spark, values, "double", lambda c: as_text(c, T.DoubleType())) == expected


def test_literal_split_and_tokens(spark):
    assert each(spark, ["a|b.c"], "string", lambda c: literal_split(c, "|")) == [["a", "b.c"]]
    assert each(spark, [" a || b |"], "string", lambda c: non_blank_tokens(c, "|")) == [["a", "b"]]


def test_regex_replacement_keeps_group_and_digit_apart(spark):
    ten = "".join(f"({c})" for c in "abcdefghij")
    assert each(spark, ["abcdefghij"], "string", lambda c: regex_replace_all(c, ten, r"\10-\2")) == ["a0-b"]
    assert each(spark, ["a"], "string", lambda c: regex_replace_all(c, "a", "$0")) == ["$0"]
    assert each(spark, ["ab"], "string", lambda c: regex_replace_all(c, "(a)", r"\\\1")) == ["\\ab"]
    assert each(spark, ["New York City", "NY"], "string", lambda c: regex_replace_all(c, "New York.*", "New York")) == ["New York", "NY"]


@pytest.mark.parametrize("name, alias, identifier", [
    ("emp-addr", "Employee Address", False), ("max.qty", "Maximum Quantity", False), ("parcel_sku", "Parcel Sku", True),
    ("netWeightKilo", "Net Weight Kilo", False), ("homePhone", "Home Phone", True), ("VAT_rate", "VAT Rate", False),
    ("-._", "-._", False), ("colour", "Colour", False),
])
def test_names(spark, name, alias, identifier):
    assert each(spark, [name], "string", alias_of) == [alias]
    assert each(spark, [name], "string", looks_like_identifier) == [identifier]
