"""The stored dataset: an immutable Parquet directory, read with its edit rules layered on."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tabsmith.operators.edits import EditRules, apply_edits


def write_dataset(df: DataFrame, path: str, partitions: int | None = None) -> str:
    """Write once; an existing path is an error, since stored data never changes."""
    (df if partitions is None else df.repartition(partitions)).write.mode("errorifexists").parquet(path)
    return path


def open_dataset(spark: SparkSession, path: str, edits: EditRules | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return apply_edits(df, edits) if edits else df


def preview(df: DataFrame, n: int = 20, order_by: Sequence[str] = ()) -> DataFrame:
    """The first rows: as they come, or by ``order_by``."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)
