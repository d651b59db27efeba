"""Profiles from stored, mergeable counts: what arrives is counted once, what is there is never read again.

The state of a table has a row per dataset, column and range unit: rows, values, text counts, and a distinct-count
sketch. States merge by adding counts and uniting sketches, in any order, so the state of an append and the stored one
give what the whole table would: counts exactly, distinct counts within the error of a sketch.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.operators.profile import MULTI_VALUE_SEPARATORS, _finished, _is_text, _text_facts, _typed_value, digest

# A sketch has two to this power of registers; an estimate's relative standard error is 1.04 over their root.
REGISTERS_LOG2 = 12
STANDARD_ERROR = 1.04 / 2 ** (REGISTERS_LOG2 / 2)
#: Within this relative error lie all but one estimate in some hundred millions.
ERROR_BOUND = 6 * STANDARD_ERROR
KEYS = ["dataset", "name", "type", "is_text", "position", "unit"]
SUMS = ["row_count", "value_count", "total_length", *[f"splits_{i}" for i in range(len(MULTI_VALUE_SEPARATORS))], "ranges"]


def column_states(df: DataFrame, dataset: str = "data", by: str | None = None) -> DataFrame:
    """The state of every column of ``df`` (per dataset named in the column ``by``, if given), from one scan."""
    cells = []
    for i, f in enumerate(f for f in df.schema if f.name != by):
        kind, value = _typed_value(f.name, f.dataType)
        text = value if kind in ("text", "other") else f"CAST({value} AS STRING)"
        name = f.name.replace("\\", "\\\\").replace("'", "\\'")
        facts = _text_facts(text) if _is_text(f.dataType) else f"{_text_facts('CAST(NULL AS STRING)')}"
        cells.append(
            f"named_struct('name', '{name}', 'type', '{f.dataType.simpleString()}', 'is_text', {str(_is_text(f.dataType)).lower()}, "
            f"'position', {i}, 'value', {digest(text)}, 'facts', {facts})")
    quoted = None if by is None else "`" + by.replace("`", "``") + "`"
    named = F.lit(dataset) if quoted is None else F.col(quoted).cast("string")
    long = df.select(named.alias("dataset"), F.inline(F.array(*map(F.expr, cells))))
    flags = [F.coalesce(F.count_if(f"facts.{c}"), F.lit(0)).alias(c) for c in SUMS if c.startswith("splits_")]
    return long.groupBy(*KEYS[:-1], F.col("facts.unit").alias("unit")).agg(
        F.count(F.lit(1)).alias("row_count"), F.count("value").alias("value_count"),
        F.coalesce(F.sum("facts.length"), F.lit(0)).cast("long").alias("total_length"), *flags, F.count_if("facts.is_range").alias("ranges"),
        F.hll_sketch_agg("value", REGISTERS_LOG2).alias("sketch"),
    )


def merged(states: DataFrame) -> DataFrame:
    """States with the same key as one."""
    return states.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS], F.hll_union_agg("sketch").alias("sketch"))


def append_states(df: DataFrame, path: str, dataset: str = "data", by: str | None = None) -> None:
    """Adds the state of arriving rows to those stored under ``path``. Stored data is not read."""
    column_states(df, dataset, by).write.mode("append").parquet(path)


def compact_states(spark: SparkSession, path: str, into: str) -> None:
    """Stores the merged states anew, one row per key."""
    merged(spark.read.parquet(path)).write.parquet(into)


def estimated_profile(states: DataFrame) -> DataFrame:
    """The profile of each dataset from its states; distinct counts are estimates, within ``ERROR_BOUND`` nearly always.

    Sketches of few values are exact. An empty table has no state, so no columns either.
    """
    one = merged(states)
    unit = F.min_by("unit", F.when(F.col("unit").isNotNull(), F.struct(-F.col("ranges"), F.col("unit")))).alias("unit")
    columns = one.groupBy(*KEYS[:-1]).agg(*[F.sum(c).alias(c) for c in SUMS], unit, F.hll_union_agg("sketch").alias("sketch"))
    values = F.when(F.col("is_text"), F.nullif("value_count", F.lit(0)))
    counts = columns.select(
        "dataset", "name", "type", "is_text", "position", "row_count", (F.col("row_count") - F.col("value_count")).alias("null_count"),
        F.least(F.hll_sketch_estimate("sketch"), F.col("value_count")).alias("distinct_count"),
        (F.col("total_length") / values).alias("avg_length"),
        *[(F.col(c) / values).alias(c) for c in SUMS if c.startswith("splits_") or c == "ranges"], "unit",
    )
    return _finished(counts, None, None)
