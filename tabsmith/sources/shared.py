"""The folder that driver and executors share."""
from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A fresh name under ``spark.checkpoint.dir``; one of its own only where none is set, in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tabsmith-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid4().hex}"
