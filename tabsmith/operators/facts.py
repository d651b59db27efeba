"""What a chart's result says: plain facts, and a fingerprint that tells whether it changed."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.numbers import round_tenths

# Most facts per chart.
MAX_FACTS = 5
# A single bin or category this many standard deviations over the mean counts as an outlier.
OUTLIER = 2.0


def chart_facts(result: DataFrame, partition_type: str, key: str | None = None, value: str = "count") -> DataFrame:
    """At most five facts about an aggregated chart: position, fact, subject, number.

    All come from one aggregate, so a result of any length stays distributed. Less than two
    rows are "too sparse".
    """
    key = key or {"datetime": "period", "numerical_bins": "bucket"}.get(partition_type, "category")
    subject = F.date_format(key, "yyyy-MM-dd") if partition_type == "datetime" else F.col(key).cast("string")
    rows = result.select(F.col(key).alias("k"), subject.alias("s"), F.col(value).cast("double").alias("v"))
    # Only bins have a place on a number line.
    position = F.col("k").cast("double") if partition_type == "numerical_bins" else F.lit(0.0)
    high = F.struct(-F.col("v"), F.col("k"))
    summary = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("v").alias("total"),
        F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("spread"),
        F.min_by(F.struct("s", "v"), high).alias("top"),
        F.min_by(F.struct("s", "v"), F.struct("v", "k")).alias("low"),
        F.min_by(F.struct("s", "v"), F.col("k")).alias("first"),
        F.max_by(F.struct("s", "v"), F.col("k")).alias("last"),
        *[F.sum(F.col("v") * position ** i).alias(f"moment{i}") for i in (1, 2, 3)],
    )

    def fact(name: str, subject_: Column, number: Column) -> Column:
        return F.struct(F.lit(name).alias("fact"), subject_.alias("subject"), number.cast("double").alias("number"))

    total = F.nullif(F.col("total"), F.lit(0.0))
    top, low, first, last = (F.col(c) for c in ("top", "low", "first", "last"))
    change = last["v"] - first["v"]
    direction = F.when(change > 0, "up").when(change < 0, "down").otherwise("flat")
    m1, m2, m3 = (F.col(c) / total for c in ("moment1", "moment2", "moment3"))
    variance = m2 - m1 * m1
    skew = (m3 - m1 * m2 * 3 + m1 * m1 * m1 * 2) / F.pow(F.nullif(variance, F.lit(0.0)), F.lit(1.5))
    found = [
        fact("largest", top["s"], top["v"]),
        fact("largest_share", top["s"], round_tenths(top["v"] / total * 100, ties="up")),
    ]
    if partition_type == "datetime":
        found.append(fact("trend", direction, change))
    elif partition_type == "numerical_bins":
        lean = F.when(skew > 0.5, "right").when(skew < -0.5, "left").otherwise("balanced")
        found.append(fact("skew", lean, F.round(skew, 6)))
    found.append(fact("smallest", low["s"], low["v"]))
    found.append(
        F.when(top["v"] > F.col("mean") + F.col("spread") * OUTLIER, fact("outlier", top["s"], top["v"]))
    )
    present = F.filter(F.array(*found[:MAX_FACTS]), lambda x: x.isNotNull())
    sparse = F.array(fact("too_sparse", F.lit(None).cast("string"), F.col("n")))
    facts = F.when(F.col("n") < 2, sparse).otherwise(present)
    return summary.select(F.posexplode(facts).alias("position", "row")).select("position", "row.*")


def result_fingerprint(result: DataFrame, column: str, chart_type: str, partition_type: str) -> DataFrame:
    """SHA-256 of a chart's identity and result, whatever the order of its rows. The title is left out.

    Rows are hashed one by one and their digests added up in four parts, so no task sees the whole
    result; the sums, the row count and the chart's identity make the final digest.
    """
    null = "\\N"
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(null)) for c in result.columns]
    digest = F.sha2(F.concat_ws("\x1f", *texts), 256)
    parts = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)").alias(f"p{i}") for i in range(4)]
    sums = result.select(*parts).agg(
        F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(f"p{i}"), F.lit(0)).cast("decimal(38,0)").alias(f"p{i}") for i in range(4)]
    )
    identity = [F.lit(x) for x in (column, chart_type, partition_type, ",".join(result.columns))]
    whole = F.concat_ws("\x1f", *identity, F.col("n").cast("string"), *[F.col(f"p{i}").cast("string") for i in range(4)])
    return sums.select(F.sha2(whole, 256).alias("fingerprint"))
