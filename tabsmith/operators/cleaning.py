"""Cleaning: null sentinels, type inference, date and money normalisation, conversion losses.

Every decision about a table comes from one aggregate over its text columns (`text_facts`), whatever
the number of columns; the driver only ever holds one row per column.
"""
from __future__ import annotations

from collections.abc import Collection, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.dates import parse_date
from tabsmith.functions.numbers import looks_like_money, parse_numeric_string
from tabsmith.functions.text import nullify

# The share of a column's values that must fit before it is converted.
DATE_SHARE = 0.8
MONEY_SHARE = 0.8

# The shape a trimmed text must have to count as a value of a type.
INTEGER = r"^-?(0|[1-9]\d*)$"
DECIMAL = r"^-?(?!0\d)(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
BOOLEAN = r"^(?i)(true|false|t|f|yes|no)$"
DATE = r"^\d{4}-\d{1,2}-\d{1,2}$"
TIMESTAMP = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?$"
ZONED = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}(:?\d{2})?)$"


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))]


def column(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def nullify_sentinels(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    names = set(columns) if columns is not None else set(text_columns(df))
    return df.select([nullify(column(c)).alias(c) if c in names else column(c) for c in df.columns])


def value_type(text: Column) -> Column:
    """The narrowest type whose shape and cast a single text value passes, NULL for plain text."""
    t = F.trim(text)
    first, size = F.substring(t, 1, 1), F.length(t)
    digit = first.between("0", "9")
    number = (
        F.when(
            t.rlike(INTEGER),
            F.when(t.try_cast("bigint").isNotNull(), "bigint")
            .when(t.try_cast("decimal(38,0)").isNotNull(), "decimal(38,0)")
            .otherwise("double"),
        ).when(t.rlike(DECIMAL), "double")
    )
    moment = (
        F.when((size <= 10) & t.rlike(DATE), F.when(t.try_cast("date").isNotNull(), "date"))
        .when(t.rlike(TIMESTAMP), F.when(t.try_cast("timestamp_ntz").isNotNull(), "timestamp_ntz"))
        .when(t.rlike(ZONED), F.when(t.try_cast("timestamp").isNotNull(), "timestamp"))
    )
    # The first character and the length spare most texts the regular expressions.
    return (
        F.when(digit & (F.substring(t, 5, 1) == "-") & (size >= 8), moment)
        .when(digit | first.isin("-", "."), number)
        .when((size <= 5) & t.rlike(BOOLEAN), "boolean")
    )


@dataclass(frozen=True)
class TextFacts:
    """Counts over the non-null values of one text column."""

    values: int
    types: Mapping[str, int]
    dates: int
    money_shaped: int
    money_parsed: int

    @property
    def inferred_type(self) -> str:
        """The first type that every value fits."""
        fits = lambda *names: self.values > 0 and sum(self.types[n] for n in names) == self.values
        for target, accepted in TYPE_LADDER.items():
            if fits(*accepted):
                return target
        return "string"

    @property
    def is_date(self) -> bool:
        return self.values > 0 and self.dates / self.values >= DATE_SHARE

    @property
    def is_money(self) -> bool:
        return self.values > 0 and self.money_shaped / self.values >= MONEY_SHARE


# A column gets the first type on this ladder whose accepted value types cover all its values.
TYPE_LADDER = {
    "bigint": ("bigint",),
    "decimal(38,0)": ("bigint", "decimal(38,0)"),
    "double": ("bigint", "decimal(38,0)", "double"),
    "boolean": ("boolean",),
    "date": ("date",),
    "timestamp_ntz": ("date", "timestamp_ntz"),
    "timestamp": ("date", "timestamp_ntz", "timestamp"),
}
_VALUE_TYPES = ("bigint", "decimal(38,0)", "double", "boolean", "date", "timestamp_ntz", "timestamp")


def text_facts(
    df: DataFrame, columns: Iterable[str] | None = None, day_first: bool = False, extra: Column | None = None,
    tests: Collection[str] = ("type", "date", "money"),
) -> dict[str | None, TextFacts]:
    """One pass over the text columns; the result has one row per column.

    The values are taken as (column, text) rows, so the plan and its generated code stay the same
    size however wide the table is, and small enough for the JVM to compile. ``extra`` is one more
    text whose facts come under None. Facts of a test that is left out of ``tests`` are 0.
    """
    names = list(columns) if columns is not None else text_columns(df)
    cells = [column(c) for c in names] + ([] if extra is None else [extra])
    if not cells:
        return {}
    long = df.select(F.posexplode(F.array(*cells)).alias("position", "value")).filter("value IS NOT NULL")
    value, no = F.col("value"), F.lit(False)
    tested = long.select(
        "position",
        (value_type(value) if "type" in tests else F.lit(None).cast("string")).alias("type"),
        (parse_date(value, day_first).isNotNull() if "date" in tests else no).alias("date"),
        (looks_like_money(value) if "money" in tests else no).alias("money"),
        (parse_numeric_string(value).isNotNull() if "money" in tests else no).alias("number"),
    )
    # At most a few dozen combinations per column come back.
    outcomes = tested.groupBy(*tested.columns).agg(F.count(F.lit(1)).alias("n")).collect()
    facts = {}
    for position, name in enumerate([*names, None][: len(cells)]):
        mine = [r for r in outcomes if r["position"] == position]
        total = lambda holds: sum(r["n"] for r in mine if holds(r))
        facts[name] = TextFacts(
            values=total(lambda r: True),
            types={t: total(lambda r: r["type"] == t) for t in _VALUE_TYPES},
            dates=total(lambda r: r["date"]),
            money_shaped=total(lambda r: r["money"]),
            money_parsed=total(lambda r: r["number"]),
        )
    return facts


def infer_types(df: DataFrame, facts: Mapping[str, TextFacts] | None = None) -> DataFrame:
    """Cast every text column to the narrowest type that all its values fit."""
    facts = text_facts(df, tests=("type",)) if facts is None else facts
    return df.select([
        F.trim(column(c)).try_cast(facts[c].inferred_type).alias(c)
        if c in facts and facts[c].inferred_type != "string" else column(c)
        for c in df.columns
    ])


def detect_date_columns(df: DataFrame, facts: Mapping[str, TextFacts] | None = None) -> list[str]:
    facts = text_facts(df, tests=("date",)) if facts is None else facts
    return [c for c in df.columns if c in facts and facts[c].is_date]


def detect_numeric_strings(df: DataFrame, facts: Mapping[str, TextFacts] | None = None) -> list[str]:
    """Text columns holding money, percent or thousands-separated numbers. Dates are looked for first."""
    facts = text_facts(df, tests=("date", "money")) if facts is None else facts
    return [c for c in df.columns if c in facts and facts[c].is_money and not facts[c].is_date]


def normalize_dates(df: DataFrame, columns: Iterable[str] | None = None, day_first: bool = False) -> DataFrame:
    names = detect_date_columns(df) if columns is None else columns
    return df.withColumns({c: parse_date(column(c), day_first) for c in names})


def normalize_numeric_strings(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    names = detect_numeric_strings(df) if columns is None else columns
    return df.withColumns({c: parse_numeric_string(column(c)) for c in names})


def conversion_losses(df: DataFrame, parsed: Mapping[str, Column]) -> DataFrame:
    """Per column: values before the conversion, and how many of them it turned into NULL."""
    per_column = [
        F.struct(
            F.lit(name).alias("name"),
            F.count(column(name)).alias("non_null_before"),
            F.count_if(column(name).isNotNull() & after.isNull()).alias("newly_null"),
        )
        for name, after in parsed.items()
    ]
    return df.agg(F.array(*per_column).alias("rows")).select(F.inline("rows"))


# The two warning texts.
DATE_WARNING = "%d of %d non-null values did not match a recognized date format and were set to NULL."
MONEY_WARNING = "%d of %d non-null values were not recognized as numbers (after stripping $/,/%%) and were set to NULL."


def conversion_warning(newly_null: Column, non_null_before: Column, template: str = DATE_WARNING) -> Column:
    return F.when(newly_null > 0, F.format_string(template, newly_null, non_null_before))
