"""Chart specifications: what to compute for a chart, kept structured so that filters compose with it."""
from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.operators import charts, ranges, tags
from tabsmith.operators.charts import DEFAULT_BINS, ChartFilter
from tabsmith.operators.cleaning import column
from tabsmith.operators.edits import EditRules, apply_edits, raw_values
from tabsmith.operators.inverse import filter_edited

# Partition types in priority order, and chart types.
PARTITION_TYPES = ("datetime", "numerical_bins", "categorical")
CHART_TYPES = ("line", "bar", "pie", "histogram", "bell_curve")
PIE_MAX = 6


@dataclass(frozen=True)
class ChartSpec:
    column: str
    partition_type: str
    chart_type: str
    title: str = ""
    rationale: str = ""
    grain: str = "month"
    bins: int = DEFAULT_BINS
    measure: str | None = None
    agg: str = "count"
    tags: tags.TagConfig | None = None
    range: ranges.RangeConfig | None = None
    source: str = "auto"
    id: str = ""
    error: str | None = None

    def __post_init__(self):
        if self.partition_type not in PARTITION_TYPES or self.chart_type not in CHART_TYPES:
            raise ValueError(f"unknown chart {self.partition_type!r} / {self.chart_type!r}")

    def apply(self, df: DataFrame) -> DataFrame:
        if self.measure:
            by = {"numerical_bins": "bins"}.get(self.partition_type, self.partition_type)
            by = "category" if by == "categorical" else by
            return charts.measure_by(df, self.column, self.measure, self.agg, by, self.grain, self.bins)
        if self.tags:
            return tags.tag_chart(df, self.column, self.tags)
        if self.range:
            return ranges.range_histogram(df, self.column, self.range, self.bins)
        if self.partition_type == "datetime":
            return charts.time_series(df, self.column, self.grain)
        if self.partition_type == "categorical":
            return charts.category_counts(df, self.column)
        result = charts.histogram(df, self.column, self.bins)
        return charts.bell_curve(result, self.bins) if self.chart_type == "bell_curve" else result


def run_chart(
    df: DataFrame,
    spec: ChartSpec,
    filter_: ChartFilter | None = None,
    bins: int | None = None,
    edits: EditRules | None = None,
    dictionaries: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """The chart under a cross-filter and a chosen bin count; a filter on its own column is left out.

    With ``edits``, ``df`` is the stored data. An equality filter on a merged text column then becomes
    a list of stored values, which the Parquet scan can use; on the edited text it could not. Replacements and
    other types need the column's stored values for that (`inverse.open_dictionary`), by column in ``dictionaries``.
    """
    if filter_ is not None and filter_.column == spec.column:
        filter_ = None
    known = (dictionaries or {}).get(filter_.column) if filter_ is not None else None
    if edits and known is not None and (edits.merges.get(filter_.column) or edits.replacements.get(filter_.column)):
        if filter_.lo is None and filter_.hi is None:
            wanted = F.lit(filter_.equals).cast("string")
            df, filter_ = filter_edited(df, edits, filter_.column, lambda text: text == wanted, known), None
        else:
            df = apply_edits(df, edits)
    elif edits:
        raw = None
        if filter_ is not None and filter_.lo is None and filter_.hi is None:
            if isinstance(df.schema[filter_.column].dataType, T.StringType):
                raw = raw_values(edits, filter_.column, str(filter_.equals))
        if raw is not None:
            df, filter_ = df.filter(column(filter_.column).isin(raw)), None
        df = apply_edits(df, edits)
    if filter_ is not None:
        df = filter_.apply(df)
    return (spec if bins is None else replace(spec, bins=bins)).apply(df)


def priority(partition_type: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PARTITION_TYPES)), partition_type).cast("int") - 1


def prioritized(recommendations: DataFrame) -> DataFrame:
    """Datetime first, then numbers, then categories; within each by position."""
    return recommendations.orderBy("dataset", priority(F.col("partition_type")), "position")


def validate_recommendations(recommendations: DataFrame, profile_df: DataFrame) -> DataFrame:
    """Drops entries with an unknown column, partition or chart type, or a blank title or query."""
    proposed = recommendations.filter(
        F.col("partition_type").isin(*PARTITION_TYPES)
        & F.col("chart_type").isin(*CHART_TYPES)
        & (F.trim("title") != "")
        & (F.trim("sql") != "")
    )
    known = profile_df.select("dataset", F.col("name").alias("column")).distinct()
    return proposed.join(known, ["dataset", "column"], "left_semi").select(*recommendations.columns)
