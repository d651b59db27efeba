"""What the operators of this subpackage share: saved tables, row numbers, text rules."""
from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; ``bytes.split()`` cuts UTF-8 at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """A fresh name under ``spark.checkpoint.dir``; one of its own only where none is set, in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    root = root or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tabsmith-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, unless they find it where the driver does: by path or in their folder."""
    root, context = str(Path(__file__).resolve().parents[2]), spark.sparkContext
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if root in map(os.path.realpath, known) or any("tabsmith" in str(f) for f in context._python_includes):
        return
    archive = Path(tempfile.mkdtemp()) / "tabsmith"
    context.addPyFile(shutil.make_archive(str(archive), "zip", root, "tabsmith"))


def saved(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes to the shared folder and reads back: cuts the lineage, and later jobs see the same rows."""
    path = shared_folder(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables saved on the way to a result, in one shared folder that goes when the result is there."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.tables = spark, shared_folder(spark), 0

    def saved(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        path = f"{self.folder}/{self.tables}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure: object) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """Renames columns called like ``names`` (in any case), so that an operator can use those; gives old and new names."""
    taken, prefix = {n.lower() for n in names}, "_aside"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    moved = {c: f"{prefix}{k}" for k, c in enumerate(df.columns) if c.lower() in taken}
    return df.withColumnsRenamed(moved), moved


def put_back(df: DataFrame, columns: list[str], moved: dict[str, str]) -> DataFrame:
    """The columns an operator began with, under their old names."""
    return df.select(*[F.col(f"`{moved.get(c, c)}`").alias(c) for c in columns])


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} among {', '.join(df.columns)}")
