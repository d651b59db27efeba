"""Session settings the library expects. Every operator also works in a session built elsewhere."""
from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.runSQLOnFiles": "false",
}


def build_session(master: str | None = None, app_name: str = "tabsmith", **conf: str) -> SparkSession:
    """A session with the library's settings; on a cluster leave ``master`` to spark-submit.

    ``spark.sql.shuffle.partitions`` is left to the caller: AQE merges small partitions, so on a
    cluster set it high enough for the largest shuffle (about 128 MB each).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
