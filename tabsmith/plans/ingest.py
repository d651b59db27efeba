"""From a CSV file to a clean stored dataset with its profile."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tabsmith.operators.cleaning import nullify_sentinels
from tabsmith.operators.profile import dataset_summary, profile
from tabsmith.sources.csv import CleaningPlan, plan_cleaning, read_csv_text
from tabsmith.sources.dataset import open_dataset, preview, write_dataset


@dataclass(frozen=True)
class Ingested:
    data: DataFrame
    profile: DataFrame
    summary: DataFrame
    preview: DataFrame
    plan: CleaningPlan


def ingest_csv(
    spark: SparkSession,
    csv_path: str,
    dataset_path: str,
    dataset: str = "data",
    delimiter: str | None = None,
    multi_line: bool = True,
    day_first: bool = False,
    exact: bool = True,
) -> Ingested:
    """Two passes over the text (one aggregate that decides the casts, one that writes), then the
    profile over the Parquet files. The driver holds one row of statistics."""
    raw = read_csv_text(spark, csv_path, delimiter, multi_line)
    plan = plan_cleaning(raw, day_first)
    write_dataset(plan.apply(nullify_sentinels(raw)), dataset_path)
    data = open_dataset(spark, dataset_path)
    profiled = profile(data, dataset, warnings=plan.warnings, samples=True, exact=exact)
    return Ingested(data, profiled, dataset_summary(profiled), preview(data), plan)
