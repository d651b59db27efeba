"""Ranges: text such as "4-10 yrs" read as a number."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.numbers import to_double
from tabsmith.functions.text import as_text
from tabsmith.operators.charts import DEFAULT_BINS, binned_counts
from tabsmith.operators.cleaning import column


@dataclass(frozen=True)
class RangeConfig:
    separator: str = "-"
    unit: str | None = None
    value_type: str = "midpoint"

    def __post_init__(self):
        if self.value_type not in ("min", "max", "midpoint"):
            raise ValueError(f"unknown range value {self.value_type!r}")


def parse_range(text: Column, config: RangeConfig = RangeConfig()) -> Column:
    """The low end, high end or midpoint; NULL when a needed end is not a number."""

    def end(n: int) -> Column:
        piece = F.split_part(text, F.lit(config.separator or "-"), F.lit(n))
        return to_double(F.replace(piece, F.lit(config.unit), F.lit("")) if config.unit else piece)

    if config.value_type == "min":
        return end(1)
    if config.value_type == "max":
        return end(2)
    return (end(1) + end(2)) / 2


def _parsed(df: DataFrame, name: str, config: RangeConfig) -> DataFrame:
    text = df.select(as_text(column(name), df.schema[name].dataType).alias("raw")).filter("raw IS NOT NULL")
    return text.select("raw", parse_range(F.col("raw"), config).alias("parsed"))


def range_preview(df: DataFrame, name: str, config: RangeConfig = RangeConfig(), n: int = 20, order_by: Sequence[str] = ()) -> DataFrame:
    """The first non-null cells and what they parse to: as they come, or by ``order_by``."""
    present = df.filter(column(name).isNotNull())
    return _parsed((present.orderBy(*order_by) if order_by else present).limit(n), name, config)


def range_parse_counts(df: DataFrame, name: str, config: RangeConfig = RangeConfig()) -> DataFrame:
    """How many non-null cells parse, over the whole column."""
    return _parsed(df, name, config).agg(
        F.count("parsed").alias("parsed"), F.count(F.lit(1)).alias("total")
    )


def range_histogram(
    df: DataFrame, name: str, config: RangeConfig = RangeConfig(), bins: int = DEFAULT_BINS
) -> DataFrame:
    values = _parsed(df, name, config).select(F.col("parsed").alias("value"))
    return binned_counts(values, bins).select("bucket", "count", "min_val", "max_val").orderBy("bucket")
