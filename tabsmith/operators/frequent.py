"""Most frequent values in two passes: a frequent-items sketch names candidates, a second pass counts those exactly.

A value that the sketch doesn't hold occurs at most `missed_at_most` times. If the last value of the answer occurs more
often, none is missing and no tie is cut wrongly; nor is one if the candidates' counts add up to all values. Otherwise
(values that hardly repeat) all values are counted.
Either way the answer is exact; the shuffle of the two passes holds candidates only.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.operators.cleaning import column

# Most values that a sketch holds, and its a-priori error: a share of all values.
MOST_ITEMS = 1 << 15
ERROR_SHARE = 3.5
# As many candidates as a sketch can still hold when it has to drop some.
LOAD = 0.75


def missed_at_most(values: int, items: int = MOST_ITEMS) -> int:
    """How often a value that is no candidate can occur among so many."""
    return int(values * ERROR_SHARE / items)


def top_values(df: DataFrame, name: str, limit: int, items: int = MOST_ITEMS) -> DataFrame:
    """value, count of the ``limit`` most frequent non-null values of a column, of equals the smallest first."""
    present = df.select(column(name).alias("value")).filter("value IS NOT NULL")
    wanted = int(items * LOAD)
    if limit < wanted:
        sketch = present.agg(F.count("value").alias("n"), F.expr(f"approx_top_k(value, {wanted}, {items})").alias("top"))
        found = sketch.select("n", F.col("top.item").alias("items")).first()
        # A list of known length: at most ``wanted`` values.
        names = df.sparkSession.createDataFrame([(v,) for v in found["items"] or ()], present.schema)
        counts = present.join(F.broadcast(names), "value", "left_semi").groupBy("value").agg(F.count(F.lit(1)).alias("count"))
        best = counts.orderBy(F.desc("count"), "value").limit(limit).collect()
        proved = len(best) == limit and best[-1]["count"] > missed_at_most(found["n"], items)
        if proved or counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0] == found["n"]:  # or there is no other value
            return df.sparkSession.createDataFrame(best, counts.schema).orderBy(F.desc("count"), "value")
    counts = present.groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "value").limit(limit)
