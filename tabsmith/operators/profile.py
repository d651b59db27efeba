"""Column profiles: counts, classification, hints. One table, or a whole catalog of datasets, per call.

Exact mode turns the table into (dataset, column, value) rows, by type of value, and groups them. All
else is read off the distinct values and their counts, so patterns are tested once per distinct
value, a value that fills a column costs one row after the map-side combine, and there is no
per-column query.
"""
from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.names import alias_of, looks_like_identifier
from tabsmith.functions.numbers import round_tenths
from tabsmith.functions.text import as_text
from tabsmith.operators.cleaning import column

# Thresholds of the classification and of the two shape hints.
NUMERIC_CATEGORIES = 20
TEXT_CATEGORIES = 50
TEXT_RATIO = 0.05
FREE_TEXT_RATIO = 0.5
FREE_TEXT_LENGTH = 40
REVIEW_BELOW = 70.0
MULTI_VALUE_SHARE = 0.5
RANGE_SHARE = 0.5
MULTI_VALUE_SEPARATORS = (",", ";", "|", "/")
RANGE_TEXT = r"^\s*(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*$"
SAMPLE_ROWS, SAMPLE_VALUES = 20, 5

# Type names by family, in Spark's and in SQL's vocabulary.
NUMERIC_TYPES = (
    "TINYINT", "SMALLINT", "INT", "INTEGER", "BIGINT", "HUGEINT", "UTINYINT", "USMALLINT", "UINTEGER",
    "UBIGINT", "FLOAT", "DOUBLE", "DECIMAL", "REAL",
)
DATETIME_TYPES = ("DATE", "TIMESTAMP", "TIMESTAMP_NTZ", "TIMESTAMP WITH TIME ZONE", "TIMESTAMPTZ", "TIME")
TEXT_TYPES = ("STRING", "VARCHAR", "CHAR", "TEXT", "BLOB", "BINARY")
CATEGORIES = ("datetime", "continuous_numerical", "categorical", "free_text")

PROFILE_COLUMNS = (
    "dataset", "name", "type", "alias", "category", "category_source", "confidence", "needs_review",
    "rationale", "row_count", "null_count", "null_percentage", "distinct_count", "avg_length",
    "health_score", "conversion_warning", "multi_value_separator", "range_separator", "range_unit",
    "samples",
)

# A longer text is grouped by its SHA-256 digest, its facts beside it, instead of being shuffled whole.
LONG_TEXT = 256


def _in(values: Iterable[str]) -> str:
    return "IN (" + ", ".join(f"'{v}'" for v in values) + ")"


# Each rule: condition, category, confidence before rounding. The first that holds decides.
_NUMBER_SCORE = f"60.0D + least(abs(distinct_count - {NUMERIC_CATEGORIES}) / {NUMERIC_CATEGORIES}.0D, 1.0D) * 39.0D"
CLASSIFICATION = (
    (f"_kind {_in(DATETIME_TYPES)}", "datetime", "99.0D"),
    ("_kind = 'BOOLEAN'", "categorical", "99.0D"),
    (f"_kind {_in(NUMERIC_TYPES)} AND distinct_count <= {NUMERIC_CATEGORIES}", "categorical", _NUMBER_SCORE),
    (f"_kind {_in(NUMERIC_TYPES)} AND _identifier", "categorical", "65.0D"),
    (f"_kind {_in(NUMERIC_TYPES)}", "continuous_numerical", _NUMBER_SCORE),
    ("row_count = 0", "categorical", "50.0D"),
    (
        f"distinct_count <= greatest({TEXT_CATEGORIES}, row_count * {TEXT_RATIO}D) AND _ratio <= {TEXT_RATIO}D",
        "categorical",
        f"60.0D + least(({TEXT_RATIO}D - _ratio) / {TEXT_RATIO}D, 1.0D) * 39.0D",
    ),
    (f"avg_length > {FREE_TEXT_LENGTH}", "free_text", "85.0D"),
    (
        f"_ratio > {FREE_TEXT_RATIO}D",
        "free_text",
        f"60.0D + least((_ratio - {FREE_TEXT_RATIO}D) / {FREE_TEXT_RATIO}D, 1.0D) * 39.0D",
    ),
    ("true", "categorical", "55.0D"),
)


def classify(stats: DataFrame) -> DataFrame:
    """Adds category, confidence, review flag, alias and health to the counts of a column.

    Needs name, type, row_count, null_count, distinct_count and avg_length.
    """
    name = F.col("name")
    inputs = stats.withColumns({
        "_kind": F.expr("upper(trim(split_part(type, '(', 1)))"),
        "_identifier": looks_like_identifier(name),
        "_ratio": F.expr("CAST(distinct_count AS DOUBLE) / nullif(row_count, 0)"),
    })
    category = " ".join(f"WHEN {condition} THEN '{chosen}'" for condition, chosen, _ in CLASSIFICATION)
    score = " ".join(f"WHEN {condition} THEN {value}" for condition, _, value in CLASSIFICATION)
    scored = inputs.withColumns({"category": F.expr(f"CASE {category} END"), "_score": F.expr(f"CASE {score} END")})
    confidence = round_tenths(F.col("_score"))
    absent = F.expr("null_count / nullif(row_count, 0)")
    return scored.withColumns({
        "alias": alias_of(name),
        "category_source": F.lit("rule"),
        "confidence": confidence,
        "needs_review": confidence < REVIEW_BELOW,
        "null_percentage": F.coalesce(round_tenths(absent * 100), F.lit(0.0)),
        "health_score": column_health(F.col("row_count"), F.col("null_count")),
    }).drop("_kind", "_identifier", "_ratio", "_score")


def column_health(row_count: Column, null_count: Column) -> Column:
    """Percent of values present; 0 for an empty table."""
    return F.coalesce(round_tenths((1 - null_count / F.nullif(row_count, F.lit(0))) * 100), F.lit(0.0))


def dataset_summary(profile_df: DataFrame) -> DataFrame:
    """Columns, rows and mean column health per dataset."""
    return profile_df.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("columns"),
        F.max("row_count").alias("row_count"),
        round_tenths(F.avg("health_score")).alias("health_score"),
    )


def dataset_health(profile_df: DataFrame) -> DataFrame:
    """One mean over all columns given; 100 if there are none."""
    return profile_df.agg(F.coalesce(round_tenths(F.avg("health_score")), F.lit(100.0)).alias("health_score"))


def _is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.VarcharType, T.CharType))


def _two_tokens(separator: str) -> str:
    """At least two non-blank pieces around a one-character separator, in one walk and without a split."""
    s = re.escape(separator)
    return rf"^[\s{s}]*[^\s{s}][^{s}]*{s}[\s{s}]*[^\s{s}]"


def _text_facts(text: str) -> str:
    """Length, separators that split it (one flag each), range shape and unit of a text, as SQL.

    The plain search comes first: it spares most texts the regular expression.
    """
    is_range = f"(contains({text}, '-') AND {text} RLIKE r'{RANGE_TEXT}')"
    splits = "".join(
        f"'splits_{i}', contains({text}, '{s}') AND {text} RLIKE r'{_two_tokens(s)}', "
        for i, s in enumerate(MULTI_VALUE_SEPARATORS)
    )
    unit = f"CASE WHEN {is_range} THEN nullif(regexp_extract({text}, r'{RANGE_TEXT}', 3), '') END"
    return f"named_struct('length', length({text}), {splits}'is_range', {is_range}, 'unit', {unit})"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _typed_value(name: str, data_type: T.DataType) -> tuple[str, str]:
    """The type a value is compared in, and its SQL. No number or date is turned into text for it."""
    c = quoted(name)
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint", f"CAST({c} AS BIGINT)"
    if isinstance(data_type, T.BooleanType):
        return "bigint", f"CAST(CAST({c} AS INT) AS BIGINT)"
    if isinstance(data_type, T.DateType):
        return "bigint", f"CAST(unix_date({c}) AS BIGINT)"
    if isinstance(data_type, T.TimestampType):
        return "bigint", f"unix_micros({c})"
    if isinstance(data_type, T.TimestampNTZType):
        return "timestamp_ntz", c
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "double", f"CAST({c} AS DOUBLE)"
    if isinstance(data_type, T.BinaryType):
        return "other", f"base64({c})"
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return "other", f"to_json({c})"
    return "text" if _is_text(data_type) else "other", f"CAST({c} AS STRING)"


def digest(text: str) -> str:
    return f"CASE WHEN length({text}) > {LONG_TEXT} THEN sha2({text}, 256) ELSE {text} END"


_COUNTS = {
    "row_count": "n",
    "null_count": "CASE WHEN NOT present THEN n END",
    "distinct_count": "CASE WHEN present THEN 1L END",
}
_TEXT_COUNTS = {
    "total_length": "of.length * n",
    **{f"splits_{i}": f"CASE WHEN of.splits_{i} THEN n END" for i in range(len(MULTI_VALUE_SEPARATORS))},
    "ranges": "CASE WHEN of.is_range THEN n END",
}


def _group_counts(df: DataFrame, kind: str, values: list[str], key: list[str]) -> DataFrame:
    """Counts of the columns compared in one type: dataset, kind, at (place among them), unit, sums.

    The values become (at, value) rows of that very type. They are grouped to distinct values, and
    those to columns; a text is taken apart once per distinct value, a long one before it is digested.
    """
    long = df.selectExpr(*key, f"posexplode(array({', '.join(values)})) AS (at, value)")
    names = ["dataset"] if key else []
    facts, unit, text_counts = "NULL", "CAST(NULL AS STRING)", {c: "CAST(NULL AS BIGINT)" for c in _TEXT_COUNTS}
    if kind in ("text", "other"):
        is_long = f"length(value) > {LONG_TEXT}"
        facts = f"CASE WHEN {is_long} THEN {_text_facts('value')} END" if kind == "text" else "NULL"
        long = long.selectExpr(*names, "at", f"{digest('value')} AS value", f"{facts} AS facts")
        long = long if kind == "text" else long.drop("facts")
    distinct = long.groupBy(*long.columns).agg(F.count(F.lit(1)).alias("n"))
    if kind == "text":
        distinct = distinct.selectExpr(*names, "at", "n", "value IS NOT NULL AS present",
                                       f"coalesce(facts, {_text_facts('value')}) AS of")
        unit, text_counts = "of.unit", _TEXT_COUNTS
    else:
        distinct = distinct.selectExpr(*names, "at", "n", "value IS NOT NULL AS present")
    sums = [F.expr(f"sum({x}) AS {name}") for name, x in {**_COUNTS, **text_counts}.items()]
    by_unit = distinct.groupBy(*names, F.lit(kind).alias("kind"), "at", F.expr(unit).alias("unit"))
    return by_unit.agg(*sums)


def _exact_counts(df: DataFrame, fields: list[T.StructField], by: str | None) -> tuple[DataFrame, list[tuple[str, int]]]:
    """The counts per (kind, at), and where each column is found."""
    places, groups = [], {}
    for f in fields:
        kind, value = _typed_value(f.name, f.dataType)
        members = groups.setdefault(kind, [])
        places.append((kind, len(members)))
        members.append(value)
    key = [f"CAST({quoted(by)} AS STRING) AS dataset"] if by else []
    # Each group reads its own columns only, so together they scan the table once.
    parts = [_group_counts(df, kind, values, key) for kind, values in groups.items()]
    both = reduce(DataFrame.unionByName, parts)
    # One row per column and unit is left. The most frequent unit is taken, of equals the first in order.
    unit = "min_by(unit, CASE WHEN unit IS NOT NULL THEN struct(-ranges, unit) END) AS unit"
    sums = [F.expr(f"coalesce(sum({c}), 0L) AS {c}") for c in (*_COUNTS, *_TEXT_COUNTS)]
    names = ["dataset"] if by else []
    return both.groupBy(*names, "kind", "at").agg(*sums, F.expr(unit)), places


def column_counts(
    df: DataFrame, dataset: str = "data", by: str | None = None, exclude: Iterable[str] = ()
) -> DataFrame:
    """The exact counts behind a profile: every column is read once and shuffled as distinct values.

    ``by`` names a column whose values are dataset names: each gets a profile of its own.
    """
    skip = {by, *exclude}
    fields = [f for f in df.schema if f.name not in skip]
    counts, places = _exact_counts(df, fields, by)
    # As many rows as the table has columns.
    described = F.broadcast(df.sparkSession.createDataFrame(
        [(*place, i, f.name, f.dataType.simpleString(), _is_text(f.dataType))
         for i, (f, place) in enumerate(zip(fields, places))],
        "kind string, at int, position int, name string, type string, is_text boolean",
    ))
    if by:
        joined = counts.join(described, ["kind", "at"])
    else:
        # From the schema outwards, so that an empty table still has a row per column.
        joined = described.join(counts, ["kind", "at"], "left").withColumn("dataset", F.lit(dataset))
    values = "CASE WHEN is_text THEN nullif(row_count - null_count, 0) END"
    shares = [*[f"splits_{i}" for i in range(len(MULTI_VALUE_SEPARATORS))], "ranges"]
    return joined.selectExpr(
        "dataset", "name", "type", "is_text", "position",
        *[f"coalesce({c}, 0L) AS {c}" for c in ("row_count", "null_count", "distinct_count")],
        f"total_length / {values} AS avg_length",
        *[f"{c} / {values} AS {c}" for c in shares],
        "unit",
    )


def _hints() -> dict[str, Column]:
    separator = F.coalesce(*[
        F.when(F.col(f"splits_{i}") >= MULTI_VALUE_SHARE, F.lit(s)) for i, s in enumerate(MULTI_VALUE_SEPARATORS)
    ])
    is_range = F.col("is_text") & (F.col("ranges") >= RANGE_SHARE)
    return {
        "multi_value_separator": F.when(F.col("is_text") & (F.col("category") == "categorical"), separator),
        "range_separator": F.when(is_range, F.lit("-")),
        "range_unit": F.when(is_range, F.col("unit")),
    }


def _finished(counts: DataFrame, warnings: Mapping[str, str] | None, samples: DataFrame | None) -> DataFrame:
    hinted = classify(counts).withColumns(_hints())
    warned = F.lit(None).cast("string")
    if warnings:
        warned = F.create_map(*[F.lit(x) for x in chain.from_iterable(warnings.items())])[F.col("name")]
    full = hinted.withColumns({"conversion_warning": warned, "rationale": F.lit(None).cast("string")})
    if samples is None:
        full = full.withColumn("samples", F.lit(None).cast("array<string>"))
    else:
        full = full.join(F.broadcast(samples), "name", "left")
    return full.select(*PROFILE_COLUMNS, "position")


def sample_values(
    df: DataFrame, rows: int = SAMPLE_ROWS, values: int = SAMPLE_VALUES, order_by: Sequence[str] = ()
) -> DataFrame:
    """Up to five distinct values of every column out of the first few rows (by ``order_by`` if given): name, samples.

    ``head`` stops after the first partitions; a ``limit`` below an aggregate would visit them all.
    """
    fields = list(df.schema)
    ordered = df.orderBy(*order_by) if order_by else df
    first = ordered.select(*[as_text(column(f.name), f.dataType).alias(str(i)) for i, f in enumerate(fields)]).head(rows)
    picked = [list(dict.fromkeys(r[i] for r in first if r[i] is not None))[:values] for i, _ in enumerate(fields)]
    return df.sparkSession.createDataFrame(
        [(f.name, p) for f, p in zip(fields, picked)], "name string, samples array<string>"
    )


def profile(
    df: DataFrame,
    dataset: str = "data",
    by: str | None = None,
    warnings: Mapping[str, str] | None = None,
    samples: bool = False,
    exact: bool = True,
) -> DataFrame:
    """The profile of every column of a table (see PROFILE_COLUMNS), or per dataset named in ``by``.

    ``exact=False`` counts distinct values by sketch in a single pass without any shuffle, and exactly
    only where the estimate is too near a threshold to classify by. With ``by`` there is no second pass: the
    counts are those of `sketches.estimated_profile`.
    """
    if by and not exact:
        from tabsmith.operators.sketches import column_states, estimated_profile

        return estimated_profile(column_states(df, by=by))
    sampled = sample_values(df) if samples and not by else None
    counts = column_counts(df, dataset, by) if exact or by else estimated_counts(df, dataset)
    return _finished(counts, warnings, sampled)


# Relative error of a distinct-count sketch.
ESTIMATE_ERROR = 0.05


def _near_threshold(data_type: T.DataType, estimate: int, rows: int) -> bool:
    """Whether the true count might lie on the other side of a limit that decides the category."""
    if isinstance(data_type, T.NumericType):
        limits = [NUMERIC_CATEGORIES]
    elif isinstance(data_type, (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        limits = []
    else:
        limits = [TEXT_CATEGORIES, TEXT_RATIO * rows, FREE_TEXT_RATIO * rows]
    return any(abs(estimate - limit) <= 4 * ESTIMATE_ERROR * estimate for limit in limits)


def estimated_counts(df: DataFrame, dataset: str = "data") -> DataFrame:
    fields, separators = list(df.schema), range(len(MULTI_VALUE_SEPARATORS))
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        c = column(f.name)
        kind, value = _typed_value(f.name, f.dataType)
        value = digest(value) if kind in ("text", "other") else value
        aggregates += [
            F.count(c).alias(f"{i}_values"),
            F.approx_count_distinct(F.expr(value), ESTIMATE_ERROR).alias(f"{i}_distinct"),
        ]
        if _is_text(f.dataType):
            facts = F.expr(_text_facts(quoted(f.name)))
            aggregates.append(F.avg(facts["length"]).alias(f"{i}_length"))
            aggregates += [F.count_if(facts[f"splits_{k}"]).alias(f"{i}_splits_{k}") for k in separators]
            aggregates.append(F.count_if(facts["is_range"]).alias(f"{i}_ranges"))
    found = df.agg(*aggregates).first().asDict()
    rows = found["rows"]
    ranges = {i for i, _ in enumerate(fields)
              if found.get(f"{i}_ranges") and found[f"{i}_ranges"] >= RANGE_SHARE * found[f"{i}_values"]}
    # Columns that need a second look (a close call, or the unit of a range) get exact counts in one more pass.
    again = [f.name for i, f in enumerate(fields)
             if i in ranges or _near_threshold(f.dataType, found[f"{i}_distinct"], rows)]
    exact = {r["name"]: r for r in column_counts(df.select(*map(column, again)), dataset).collect()} if again else {}
    out = []
    for i, f in enumerate(fields):
        values = found[f"{i}_values"]
        share = lambda key: found[key] / values if values and key in found else None
        out.append((
            dataset, f.name, f.dataType.simpleString(), _is_text(f.dataType), i, rows, rows - values,
            exact[f.name]["distinct_count"] if f.name in exact else min(found[f"{i}_distinct"], values),
            found.get(f"{i}_length"),
            *[share(f"{i}_splits_{k}") for k in separators],
            share(f"{i}_ranges"),
            exact[f.name]["unit"] if f.name in exact else None,
        ))
    return df.sparkSession.createDataFrame(out, (
        "dataset string, name string, type string, is_text boolean, position int, row_count bigint, null_count bigint, "
        "distinct_count bigint, avg_length double, "
        + "".join(f"splits_{k} double, " for k in separators) + "ranges double, unit string"
    ))
