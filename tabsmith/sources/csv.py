"""CSV scan: all columns as text, null sentinels folded, ragged files rejected, types inferred by content."""
from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.dates import parse_date
from tabsmith.functions.numbers import parse_numeric_string
from tabsmith.operators.cleaning import (
    DATE_WARNING,
    MONEY_WARNING,
    TextFacts,
    column,
    nullify_sentinels,
    text_facts,
)

CORRUPT = "_corrupt_record"
# Text that a value has and a name hasn't: numbers and dates.
VALUE = re.compile(r"\s*[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?\s*|\s*\d{4}-\d{1,2}-\d{1,2}([ T].*)?")


class MalformedCsvError(ValueError):
    """The file does not split into one consistent set of columns."""


def _options(delimiter: str, multi_line: bool) -> dict:
    return {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": multi_line}


def needs_multi_line(spark: SparkSession, path: str) -> bool:
    """Whether reading line by line could go wrong: a line leaves a quote open, or has a carriage return."""
    odd_quotes = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1
    lines = spark.read.option("lineSep", "\n").text(path)
    return not lines.filter(odd_quotes | F.col("value").contains("\r")).isEmpty()


def header_line(spark: SparkSession, path: str) -> str:
    """The first line, which all files of a folder must share."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    first = lines.filter("file_block_start = 0").groupBy("file_path").agg(F.min_by("value", "at").alias("line"))
    found = first.select(F.rtrim(F.regexp_replace("line", "\r", "")).alias("line")).distinct().limit(2).collect()
    if not found:
        raise MalformedCsvError("The CSV file is empty.")
    if len(found) > 1:
        raise MalformedCsvError(f"The files have different header lines: {found[0][0][:80]!r} and {found[1][0][:80]!r}.")
    return found[0][0]


# The delimiters looked for, the first winning a tie.
DELIMITERS = (",", ";", "\t", "|")


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The candidate that splits the header line into the most columns."""
    return max(DELIMITERS, key=re.sub(r'"[^"]*"', "", header_line(spark, path)).count)


def header_names(spark: SparkSession, path: str, delimiter: str = ",") -> list[str]:
    """Column names from the first record.

    A repeated name, in whatever case, gets a suffix (a, A_1), a blank one its position. A record with a number or
    a date in it is data: such a file has no header and is rejected.
    """
    first = spark.read.options(header=False, **_options(delimiter, True)).csv(path).first()
    if first is None:
        raise MalformedCsvError("The CSV file is empty.")
    if any(VALUE.fullmatch(v) for v in first if v):
        raise MalformedCsvError("The file has no usable header row.")
    names: list[str] = []
    taken: set[str] = set()
    for i, value in enumerate(first):
        base = name = (value or "").rstrip("\r") or f"column{i}"
        suffix = 0
        while name.lower() in taken:
            suffix += 1
            name = f"{base}_{suffix}"
        taken.add(name.lower())
        names.append(name)
    return names


def read_csv_text(spark: SparkSession, path: str, delimiter: str | None = None, multi_line: bool = True) -> DataFrame:
    """Every column as text, plus the raw record in ``_corrupt_record`` where the field count is off.

    ``delimiter=None`` goes by the header line. Records may span lines, whatever the size of a file; each file is
    then one task's work. ``multi_line=False`` splits large files, and is an error for files that it could not
    read alike: those with quoted line breaks or carriage returns.
    """
    line = header_line(spark, path)
    delimiter = max(DELIMITERS, key=re.sub(r'"[^"]*"', "", line).count) if delimiter is None else delimiter
    if not multi_line and needs_multi_line(spark, path):
        raise MalformedCsvError("Records span lines or hold carriage returns: read the file with multi_line=True.")
    names = header_names(spark, path, delimiter)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    read = spark.read.schema(schema).options(header=True, **_options(delimiter, multi_line)).csv(path)
    # Where only some lines end in a carriage return and a line feed, the first of them is left in the last value.
    return read.withColumn(names[-1], F.regexp_replace(column(names[-1]), "\r$", ""))


def assert_csv_clean(df: DataFrame, corrupt_rows: int | None = None) -> None:
    """Reject a file with ragged rows, an unsplit header or generated column names."""
    names = [c for c in df.columns if c != CORRUPT]
    if len(names) == 1 and "," in names[0]:
        raise MalformedCsvError("The header did not split into columns: check delimiter and quoting.")
    if names and all(re.fullmatch(r"column\d+", n) for n in names):
        raise MalformedCsvError("The file has no usable header row.")
    if corrupt_rows is None and CORRUPT in df.columns:
        # Spark refuses a query on the corrupt-record column alone, hence the second count.
        corrupt_rows = df.agg(F.count(CORRUPT).alias("bad"), F.count(column(names[0]))).first()["bad"]
    if corrupt_rows:
        raise MalformedCsvError(f"{corrupt_rows} rows do not have {len(names)} fields.")


@dataclass(frozen=True)
class CleaningPlan:
    """What a clean read does with each column, decided from one aggregate over the file."""

    casts: dict[str, str] = field(default_factory=dict)
    dates: tuple[str, ...] = ()
    money: tuple[str, ...] = ()
    warnings: dict[str, str] = field(default_factory=dict)
    day_first: bool = False

    def expression(self, name: str) -> Column:
        c = column(name)
        if name in self.dates:
            return parse_date(c, self.day_first)
        if name in self.money:
            return parse_numeric_string(c)
        return F.trim(c).try_cast(self.casts[name]) if name in self.casts else c

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select([self.expression(c).alias(c) for c in df.columns if c != CORRUPT])


def plan_from_facts(facts: dict[str, TextFacts], day_first: bool = False) -> CleaningPlan:
    casts = {n: f.inferred_type for n, f in facts.items() if f.inferred_type != "string"}
    left = {n: f for n, f in facts.items() if n not in casts}
    dates = tuple(n for n, f in left.items() if f.is_date)
    money = tuple(n for n, f in left.items() if f.is_money and not f.is_date)
    warnings = {n: DATE_WARNING % (left[n].values - left[n].dates, left[n].values)
                for n in dates if left[n].dates < left[n].values}
    warnings |= {n: MONEY_WARNING % (left[n].values - left[n].money_parsed, left[n].values)
                 for n in money if left[n].money_parsed < left[n].values}
    return CleaningPlan(casts, dates, money, warnings, day_first)


def plan_cleaning(df: DataFrame, day_first: bool = False) -> CleaningPlan:
    """One pass over an all-text table (as `read_csv_text` gives it) that also counts its ragged rows."""
    assert_csv_clean(df, corrupt_rows=0)
    names = [c for c in df.columns if c != CORRUPT]
    corrupt = F.col(CORRUPT) if CORRUPT in df.columns else F.lit(None).cast("string")
    facts = text_facts(nullify_sentinels(df, names), names, day_first, extra=corrupt)
    assert_csv_clean(df, corrupt_rows=facts.pop(None).values)
    return plan_from_facts(facts, day_first)


def read_csv_clean(
    spark: SparkSession,
    path: str,
    delimiter: str | None = None,
    multi_line: bool = True,
    day_first: bool = False,
) -> DataFrame:
    """Read, fold sentinels, infer types, normalise dates and money text."""
    raw = read_csv_text(spark, path, delimiter, multi_line)
    return plan_cleaning(raw, day_first).apply(nullify_sentinels(raw))
