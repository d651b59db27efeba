"""Table access, scratch space and SQL fragments shared by the registered queries."""
from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the cluster's shared space; a local one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        shared = tempfile.mkdtemp(prefix="tabsmith-")
    return f"{shared.rstrip('/')}/{uuid4().hex}"


def choose(options: list[str | Column], key: Column) -> Column:
    """The option at ``key`` modulo their number."""
    choices = F.array(*[o if isinstance(o, Column) else F.lit(o) for o in options])
    return F.get(choices, F.pmod(key, F.lit(len(options))).cast("int"))


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_choose(options: list[str], key: str) -> str:
    """``options`` are SQL expressions."""
    return f"([{', '.join(options)}])[({key}) % {len(options)} + 1]"


def r6(c: str) -> Column:
    return F.round(c, 6).alias(c)
