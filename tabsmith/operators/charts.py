"""Chart aggregations: counts by period, category and bin, and what is derived from them."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.numbers import round_tenths
from tabsmith.operators.cleaning import column
from tabsmith.operators.median import grouped_median

DEFAULT_BINS = 10
BIN_CHOICES = (5, 8, 10, 15, 20)
GRAINS = ("day", "week", "month", "year")
MEASURES = ("avg", "sum", "median", "count")


@dataclass(frozen=True)
class ChartFilter:
    """``equals`` a value, or a ``range`` from lo to hi. A range is half open, but ``closed`` takes in
    its upper end: the last bin of a histogram holds the maximum. An end left out is open."""

    column: str
    equals: Any = None
    lo: float | None = None
    hi: float | None = None
    closed: bool = False

    def condition(self, df: DataFrame) -> Column:
        c, data_type = column(self.column), df.schema[self.column].dataType
        if self.lo is None and self.hi is None:
            # The literal is cast, not the column, so that the filter reaches the Parquet scan.
            return c == F.lit(self.equals).try_cast(data_type)
        ends = [] if self.lo is None else [c >= F.lit(self.lo)]
        if self.hi is not None:
            ends.append(c <= F.lit(self.hi) if self.closed else c < F.lit(self.hi))
        return reduce(and_, ends)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.filter(self.condition(df))


def bin_filter(name: str, bucket: int, bins: int, lo: float, hi: float) -> ChartFilter:
    """The filter behind a click on a bin; the last one takes in the maximum."""
    width = (hi - lo) / bins
    last = bucket == bins - 1
    return ChartFilter(name, lo=lo + bucket * width, hi=hi if last else lo + (bucket + 1) * width, closed=last)


def period(name: str, grain: str) -> Column:
    """Start of the day, week (Monday), month or year, without a time zone."""
    if grain not in GRAINS:
        raise ValueError(f"unknown grain {grain!r}")
    return F.date_trunc(grain, column(name)).cast("timestamp_ntz")


def time_series(df: DataFrame, name: str, grain: str = "month") -> DataFrame:
    counts = df.filter(column(name).isNotNull()).groupBy(period(name, grain).alias("period"))
    return counts.agg(F.count(F.lit(1)).alias("count")).orderBy("period")


def with_period_label(series: DataFrame) -> DataFrame:
    return series.withColumn("label", F.date_format("period", "yyyy-MM-dd"))


def category_counts(df: DataFrame, name: str) -> DataFrame:
    counts = df.filter(column(name).isNotNull()).groupBy(column(name).alias("category"))
    return counts.agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "category")


def with_share(counts: DataFrame, value: str = "count") -> DataFrame:
    """Percent of the total, one decimal. The total is a scalar subquery: a window over everything
    would bring all categories into one task."""
    total = counts.agg(F.sum(value)).scalar()
    percent = F.col(value) / F.nullif(F.col("_total"), F.lit(0)) * 100
    # The total is a column first: rounding names its argument many times, and each would be a subquery.
    return counts.withColumn("_total", total).withColumn("share", round_tenths(percent, ties="up")).drop("_total")


def bucket_of(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin, the maximum in the last one. A constant column goes to the last bin whole."""
    position = F.floor((value - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins).cast("int")
    return F.least(position, F.lit(bins - 1))


def binned_counts(values: DataFrame, bins: int) -> DataFrame:
    """Histogram of a column called ``value``, with its mean, stddev, min and max on every row.

    The statistics are a scalar subquery, so the data is scanned twice and never joined; the second
    scan only shuffles one row per bin and task.
    """
    present = values.filter("value IS NOT NULL")
    stats = present.agg(
        F.struct(
            F.avg("value").alias("mean"),
            F.stddev("value").alias("stddev"),
            F.min("value").alias("min_val"),
            F.max("value").alias("max_val"),
        )
    ).scalar()
    placed = present.select("value", stats.alias("stats")).select(
        bucket_of(F.col("value"), F.col("stats.min_val"), F.col("stats.max_val"), bins).alias("bucket"), "stats"
    )
    return placed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("count"), F.any_value("stats").alias("stats")
    ).select("bucket", "count", "stats.*")


def histogram(df: DataFrame, name: str, bins: int = DEFAULT_BINS) -> DataFrame:
    values = df.select(column(name).cast("double").alias("value"))
    return binned_counts(values, bins).orderBy("bucket")


def with_bin_edges(hist: DataFrame, bins: int = DEFAULT_BINS) -> DataFrame:
    width = (F.col("max_val") - F.col("min_val")) / bins
    start = F.col("min_val") + F.col("bucket") * width
    return hist.withColumns({"bin_start": start, "bin_end": start + width})


def dense_bins(hist: DataFrame, bins: int = DEFAULT_BINS) -> DataFrame:
    """The histogram with its empty bins, as rows of count 0."""
    spine = hist.sparkSession.range(bins).select(F.col("id").cast("int").alias("bucket"))
    stats = [c for c in hist.columns if c not in ("bucket", "count")]
    # At most `bins` rows, so one window over all of them is small.
    every = Window.partitionBy(F.lit(1))
    filled = spine.join(hist, "bucket", "left")
    return filled.select(
        "bucket", F.coalesce("count", F.lit(0)).alias("count"), *[F.max(c).over(every).alias(c) for c in stats]
    ).orderBy("bucket")


def bell_curve(hist: DataFrame, bins: int = DEFAULT_BINS) -> DataFrame:
    """Height of the fitted normal curve at each bin's centre, scaled to the fullest bin; NULL when flat."""
    edged = with_bin_edges(hist, bins)
    z = ((F.col("bin_start") + F.col("bin_end")) / 2 - F.col("mean")) / F.col("stddev")
    # At most `bins` rows, so one window over all of them is small.
    tallest = F.greatest(F.max("count").over(Window.partitionBy(F.lit(1))), F.lit(1))
    return edged.withColumn("curve", F.when(F.col("stddev") > 0, tallest * F.exp(z * z * -0.5))).orderBy("bucket")


def measure_by(
    df: DataFrame,
    dimension: str,
    measure: str,
    agg: str = "avg",
    by: str = "category",
    grain: str = "month",
    bins: int = DEFAULT_BINS,
) -> DataFrame:
    """A measure aggregated per category, period or bin of another column."""
    if agg not in MEASURES:
        raise ValueError(f"unknown aggregate {agg!r}")
    present = df.filter(column(dimension).isNotNull() & column(measure).isNotNull())
    if by == "category":
        keyed, keys = present.select(column(dimension).alias("category"), column(measure).alias("_m")), ["category"]
        order = [F.desc("value"), "category"]
    elif by == "datetime":
        keyed, keys = present.select(period(dimension, grain).alias("period"), column(measure).alias("_m")), ["period"]
        order = ["period"]
    else:
        rows = present.select(column(dimension).cast("double").alias("_d"), column(measure).alias("_m"))
        stats = rows.agg(F.struct(F.min("_d").alias("lo"), F.max("_d").alias("hi"))).scalar()
        keyed = rows.select("_d", "_m", stats.alias("_s")).select(
            bucket_of(F.col("_d"), F.col("_s.lo"), F.col("_s.hi"), bins).alias("bucket"),
            F.col("_s.lo").alias("min_val"), F.col("_s.hi").alias("max_val"), "_m",
        )
        keys, order = ["bucket", "min_val", "max_val"], ["bucket"]
    if agg == "median":
        result = grouped_median(keyed, keys, "_m")
    else:
        result = keyed.groupBy(*keys).agg({"avg": F.avg, "sum": F.sum, "count": F.count}[agg]("_m").alias("value"))
    return result.orderBy(*order)


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)
