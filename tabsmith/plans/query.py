"""Read-only SQL over one dataset, under the name ``data``."""
from __future__ import annotations

from contextlib import contextmanager
from threading import Lock
from uuid import uuid4

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, Row, SparkSession

from tabsmith.plans.guard import violations

# Most rows a query hands back.
MAX_ROWS = 10_000
# The settings below belong to the session, so one text at a time is analysed under them.
_analysing = Lock()


class UnsafeQueryError(ValueError):
    """The text is not one read-only query, or not a query at all."""


@contextmanager
def _settings(spark: SparkSession, **wanted: str):
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def query(df: DataFrame, text: str) -> DataFrame:
    """Run a SELECT or WITH text against ``df``.

    The text is placed where only a query may stand, so Spark's own parser turns away any other
    statement and anything after a semicolon. Files cannot be named as tables. The analysed plan is walked
    (`guard.violations`): it may read nothing but ``df``, and call no Java methods and no user-defined functions,
    however the text spells them.
    """
    spark = df.sparkSession
    view = f"data_{uuid4().hex}"
    df.createOrReplaceTempView(view)
    wrapped = f"WITH data AS (SELECT * FROM {view})\nSELECT * FROM (\n{text.strip().removesuffix(';')}\n)"
    conf = {
        "spark.sql.runSQLOnFiles": "false",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    }
    try:
        with _analysing, _settings(spark, **conf):
            result = spark.sql(wrapped)
        if found := next(violations(result, view), None):
            raise UnsafeQueryError(f"Not allowed here: {found}.")
        return result
    except (ParseException, AnalysisException) as exc:
        raise UnsafeQueryError(str(exc)) from exc
    finally:
        spark.catalog.dropTempView(view)


def run_query(df: DataFrame, text: str, max_rows: int = MAX_ROWS) -> tuple[list[str], list[Row], bool]:
    """Columns, at most ``max_rows`` rows, and whether there were more."""
    result = query(df, text)
    rows = result.limit(max_rows + 1).collect()
    return result.columns, rows[:max_rows], len(rows) > max_rows
