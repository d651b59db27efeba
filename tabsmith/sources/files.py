"""Exact-duplicate files and rows, and the registry of stored datasets."""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.operators.lookup import free_names, spread_lookup


#: What a task holds of a file at once.
CHUNK = 8 << 20


def list_files(spark: SparkSession, path: str, owner: str | None = None) -> DataFrame:
    """path, owner, length, created_at of every file below ``path`` that is not empty: a listing, no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.lit(owner).cast("string").alias("owner"), "length", F.col("modificationTime").alias("created_at"))


def with_digests(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds ``content_hash`` (MD5): each file is read range after range in one task, whatever its size.

    Local files, S3, GCS, Azure and HDFS paths can be read; another scheme raises in the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = pa.array([_digest(path, chunk) for path in batch["path"].to_pylist()], pa.string())
            yield batch.append_column("content_hash", digests)

    return files.mapInArrow(run, T.StructType([*files.schema.fields]).add("content_hash", "string"))


def _digest(path: str, chunk: int) -> str:
    system, name = pafs.FileSystem.from_uri(_uri(path))
    state = hashlib.md5(usedforsecurity=False)
    with system.open_input_file(name) as file:
        while part := file.read_buffer(chunk):
            state.update(part)
    return state.hexdigest()


def _uri(path: str) -> str:
    """Hadoop's ``file:/x`` and ``s3a://`` as others write them; its paths are not quoted."""
    scheme, rest = re.fullmatch(r"(?:([a-z][a-z0-9+.-]*):)?(.*)", path, re.DOTALL).groups()
    if scheme in (None, "file"):
        return "file:///" + quote(rest.lstrip("/"))
    return ("s3" if scheme in ("s3a", "s3n") else scheme) + ":" + quote(rest, safe="/:@")


def file_hashes(spark: SparkSession, path: str, owner: str | None = None) -> DataFrame:
    """path, owner, content_hash, created_at of every file."""
    return with_digests(list_files(spark, path, owner)).select("path", "owner", "content_hash", "created_at")


def dedup_registry(files: DataFrame) -> DataFrame:
    """Points every file at the oldest of its owner's files with the same content.

    ``files``: path, owner, content_hash, created_at. Adds ``stored_path`` and ``is_copy``.
    """
    key = ["owner", "content_hash"]
    stored = files.groupBy(*key).agg(F.min(F.struct("created_at", "path"))["path"].alias("stored_path"))
    joined = spread_lookup(files, stored, key, ["path"])
    return joined.withColumn("is_copy", F.col("path") != F.col("stored_path"))


def dedup_files(spark: SparkSession, path: str, owner: str = "") -> DataFrame:
    """The registry of the files below ``path``: path, owner, content_hash, created_at, stored_path, is_copy.

    Only files that share their length with another one are read. A file of a length of its own has no copy, is its
    own ``stored_path``, and has no ``content_hash``.
    """
    files = list_files(spark, path, owner)
    lengths = files.groupBy("length").agg((F.count(F.lit(1)) > 1).alias("shared"))
    met = spread_lookup(files, lengths, ["length"], ["path"], "inner")
    # Spread by path: files that are read weigh far more than their rows, which would fit one task.
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    read = with_digests(met.filter("shared").drop("shared").repartition(tasks, "path"))
    alone = met.filter("not shared").drop("shared").withColumns({
        "content_hash": F.lit(None).cast("string"), "stored_path": F.col("path"), "is_copy": F.lit(False)})
    return dedup_registry(read).unionByName(alone).drop("length")


def dedup_rows(df: DataFrame, content: str, order_by: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """The first row (by ``order_by``, which must identify rows) of every distinct content.

    Only hashes and ordering columns are grouped, so a content repeated any number of times costs one
    row per task; the rows themselves are then kept by a semi join on their own identity.
    """
    # A missing content is a content too.
    digest, least = free_names(["_hash", "_first"], df)
    hashed = df.withColumn(digest, F.coalesce(F.md5(F.col(content).cast("binary")), F.lit("")))
    first = hashed.groupBy(*within, digest).agg(F.min(F.struct(*order_by)).alias(least))
    keys = [*within, digest, *order_by]
    names = free_names([f"_{k}" for k in keys], hashed)
    kept = first.select(*within, digest, f"{least}.*").select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])
    return hashed.join(kept, same, "left_semi").select(*df.columns)


def storage_refcount(registry: DataFrame) -> DataFrame:
    """Adds ``other_references``: how many other datasets use the same ``raw_key`` (0: may be deleted)."""
    uses = registry.groupBy("raw_key").agg((F.count(F.lit(1)) - 1).alias("other_references"))
    return spread_lookup(registry, uses, ["raw_key"], ["dataset"])


def list_datasets(registry: DataFrame, owner: str) -> DataFrame:
    """One owner's datasets, newest first."""
    return registry.filter(F.col("owner") == owner).orderBy(F.desc("created_at"), "dataset")
