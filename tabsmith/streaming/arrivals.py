"""Files that keep arriving: the row-level cleaning of a first file applied to each new one.

Nothing here keeps state. Types come from a plan made once (`tabsmith.sources.csv.plan_cleaning`), since
a stored dataset's schema never changes.
"""
from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tabsmith.operators.cleaning import column, nullify_sentinels
from tabsmith.sources.csv import CORRUPT, CleaningPlan


def read_csv_arrivals(
    spark: SparkSession, folder: str, names: list[str], delimiter: str = ",", check_header: bool = True
) -> DataFrame:
    """CSV files in a folder as a stream of text columns, and the raw record where its field count is off.

    Columns are read by position. A file whose header line has other names, or the same in another order, fails its
    batch, which stores nothing; without the file the stream goes on. Where ``names`` are not those of the header
    (repeated or blank ones are renamed on a first read) the check has to be left out.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    reader = spark.readStream.schema(schema).options(header=True, sep=delimiter, quote='"', escape='"', multiLine=True)
    return reader.option("enforceSchema", not check_header).csv(folder)


def append_clean(arrivals: DataFrame, plan: CleaningPlan, path: str, checkpoint: str) -> StreamingQuery:
    """Clean what has arrived since the last run and append it to a Parquet directory, each file once.

    Two folders: ``data`` has the clean rows; ``rejected`` the raw records with another number of fields, and the
    rows in which a cast lost a value, as JSON. A batch that is run again overwrites what it had written.
    """
    def write(batch: DataFrame, number: int) -> None:
        text = nullify_sentinels(batch.persist())
        names = [c for c in text.columns if c != CORRUPT]
        good = text.filter(F.col(CORRUPT).isNull())
        lost = reduce(or_, [column(c).isNotNull() & plan.expression(c).isNull() for c in names])
        clean = plan.apply(good.filter(~lost))
        clean.write.mode("overwrite").parquet(f"{path}/data/batch={number}")
        as_json = F.to_json(F.struct(*map(column, names)))
        bad = text.select(F.coalesce(CORRUPT, F.when(lost, as_json)).alias("record")).filter("record IS NOT NULL")
        bad.write.mode("overwrite").parquet(f"{path}/rejected/batch={number}")
        batch.unpersist()

    writer = arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
