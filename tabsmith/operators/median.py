"""Exact median per group without holding a group in one task.

Spark's ``median`` keeps every distinct value of a group in one task's memory. Here each group is cut
at quantiles of the whole column, so that no (group, slice) pair has more than a slice's share of the
rows, however large the group. Counting the slices finds the one or two that hold the middle, and
only those are sorted.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows a slice should hold, and the most slices along one of the two lookup steps (so 128^2 in all).
SLICE_ROWS = 1_000_000
MAX_STEP = 128


def _cut_points(rows: DataFrame, slice_rows: int) -> tuple[list[float], int]:
    """Quantiles of ``_v`` and the number of slices per lookup step. The driver gets at most 128^2 numbers."""
    n = rows.count()
    step = min(MAX_STEP, max(1, round((n / slice_rows) ** 0.5)))
    slices = step * step
    if slices == 1:
        return [], step
    quantiles = [i / slices for i in range(1, slices)]
    found = rows.agg(F.percentile_approx("_v", quantiles, 8 * slices).alias("cuts")).first()["cuts"]
    return sorted(set(found)), step


def _slice_of(value: Column, cuts: Sequence[float], step: int) -> Column:
    """How many cut points lie below the value (a function of the value alone), found in two steps."""
    if not cuts:
        return F.lit(0)
    below = lambda points: F.size(F.filter(points, lambda c: c < value))
    literal = lambda points: F.array(*map(F.lit, points))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    ends = [g[-1] for g in groups if len(g) == step]
    coarse = below(literal(ends)) if ends else F.lit(0)
    # Past the last group there is nothing left to count.
    fine = F.get(F.array(*map(literal, groups)), coarse)
    return coarse * step + F.when(fine.isNotNull(), below(fine)).otherwise(0)


def grouped_median(df: DataFrame, keys: Sequence[str], value: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Median of a numeric column per (non-null) key, as ``value``: the mean of the two middle values."""
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    cuts, step = _cut_points(rows, slice_rows)
    # One row per group and distinct value: a value shared by many rows weighs nothing below.
    counts = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    sliced = counts.withColumn("_slice", _slice_of(F.col("_v"), cuts, step))

    # At most one row per slice and key here.
    per_slice = sliced.groupBy(*keys, "_slice").agg(F.sum("_n").alias("_rows"))
    of_key = Window.partitionBy(*keys)
    so_far = of_key.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = per_slice.withColumns({
        "_total": F.sum("_rows").over(of_key),
        "_before": F.sum("_rows").over(so_far) - F.col("_rows"),
    })
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    middle = placed.filter((F.col("_before") < high) & (F.col("_before") + F.col("_rows") >= low))

    # The join keys are the window keys, so the chosen slices are shuffled once.
    chosen = sliced.join(middle, [*keys, "_slice"])
    within = Window.partitionBy(*keys, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = chosen.withColumn("_upto", F.col("_before") + F.sum("_n").over(within))
    holds = lambda rank: (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank)
    return ranked.groupBy(*keys).agg(
        ((F.max(F.when(holds(low), F.col("_v"))) + F.max(F.when(holds(high), F.col("_v")))) / 2).alias("value")
    )
