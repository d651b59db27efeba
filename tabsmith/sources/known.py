"""Duplicates among what arrives, against everything that came before, without joining it.

The registry under a folder has, per batch, the digests of its new contents with the row that came first, and Bloom
filters over them: bitmaps of `BLOCK_BITS` bits, of which a digest sets `PROBES` in the one block it falls in. A batch's
digests are tested against those blocks, and only possible hits meet the registry. A batch uses as many blocks as
all contents so far need at `BITS_PER_CONTENT`, in powers of two, so older filters never fill up, are never made anew, and
there are as many sizes as the registry has doubled. Blocks of one size merge by OR.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.operators.lookup import free_names, spread_lookup

# Fixed value: the bits of a bitmap that Spark's bitmap functions make.
BLOCK_BITS = 32768
PROBES = 4
# With four probes one in a hundred contents that are new looks known, at most.
BITS_PER_CONTENT = 10
# Up to this many possible hits (a digest and a number each) are sent to the tasks that read the registry.
BROADCAST_HITS = 500_000


def blocks_for(contents: int) -> int:
    """The number of blocks for so many contents: a power of two."""
    return 1 << max(0, (contents * BITS_PER_CONTENT - 1) // BLOCK_BITS).bit_length()


def _block(digest: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(digest), blocks)


def _positions(digest: Column) -> list[Column]:
    mixed = F.xxhash64(digest, F.lit(BLOCK_BITS))
    return [F.shiftrightunsigned(mixed, 16 * k).bitwiseAND(F.lit(BLOCK_BITS - 1).cast("long")) for k in range(PROBES)]


def block_filters(digests: DataFrame, blocks: int) -> DataFrame:
    """blocks, block, bits: the filter over a column ``digest``; blocks that no digest falls in are left out."""
    size = F.lit(blocks).cast("long")
    placed = digests.select(size.alias("blocks"), _block(F.col("digest"), size).alias("block"), F.explode(F.array(*_positions(F.col("digest")))).alias("at"))
    return placed.groupBy("blocks", "block").agg(F.bitmap_construct_agg("at").alias("bits"))


def merged_filters(filters: DataFrame) -> DataFrame:
    """The filters of several batches as one per size."""
    return filters.groupBy("blocks", "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def _is_set(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def possibly_known(digests: DataFrame, filters: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """The rows of ``digests`` (digest first, each once) that some filter may hold. ``sizes``: the numbers of blocks in use."""
    size = F.explode(F.array(*[F.lit(n).cast("long") for n in sizes])).alias("blocks")
    asked = digests.select("digest", "first", size).withColumn("block", _block(F.col("digest"), F.col("blocks")))
    met = asked.join(merged_filters(filters), ["blocks", "block"])
    for at in _positions(F.col("digest")):
        met = met.filter(_is_set(F.col("bits"), at))
    return met.select("digest", "first").distinct()


def batches(spark: SparkSession, root: str) -> DataFrame:
    """batch, blocks, contents, total: one row per finished batch, contents new in it and so far."""
    return spark.read.parquet(f"{root}/batches").select("batch", "blocks", "contents", "total")


def register(rows: DataFrame, root: str, batch: int, content: str, key: str) -> DataFrame:
    """Adds a batch of arriving rows to the registry under ``root`` and gives the rows with ``first_key`` and ``is_copy``.

    ``key`` identifies a row among all batches; of equal contents, that of the earliest batch is first, in a batch the
    smallest. A missing content is a content, equal to the empty one. Batches are numbered from 0 without gaps; a batch that
    was cut off can be run again, alike, as long as it is the last. Columns with the added names give way to them.
    Only the digests of possible hits are looked up; stored rows are not read, and the registry isn't shuffled unless
    there are more than `BROADCAST_HITS` of those.
    """
    spark = rows.sparkSession
    rows = rows.drop("first_key", "is_copy")
    before = batches(spark, root).filter(F.col("batch") < batch).collect() if batch else []
    if sorted(r["batch"] for r in before) != list(range(batch)):
        raise ValueError(f"batches before {batch} are missing or were not finished")
    [name] = free_names(["_digest"], rows)
    digested = rows.withColumn(name, F.md5(F.coalesce(F.col(content).cast("binary"), F.lit("").cast("binary"))))
    here = f"{root}/asked/batch={batch}"
    digested.groupBy(F.col(name).alias("digest")).agg(F.min(key).alias("first")).write.mode("overwrite").parquet(here)
    asked = spark.read.parquet(here)
    known = _known(spark, root, batch, asked, sorted({r["blocks"] for r in before}))
    new = asked.join(known, "digest", "left_anti") if known is not None else asked
    new.write.mode("overwrite").parquet(f"{root}/contents/batch={batch}")
    stored = spark.read.parquet(f"{root}/contents/batch={batch}")
    contents = stored.count()
    total = contents + max((r["total"] for r in before), default=0)
    block_filters(stored, blocks_for(total)).write.mode("overwrite").parquet(f"{root}/filters/batch={batch}")
    done = spark.createDataFrame([(batch, blocks_for(total), contents, total)], "batch long, blocks long, contents long, total long")
    done.coalesce(1).write.mode("overwrite").parquet(f"{root}/batches/part={batch}")
    firsts = stored if known is None else stored.unionByName(known)
    found = spread_lookup(digested, firsts.select(F.col("digest").alias(name), F.col("first").alias("first_key")), [name], [key])
    return found.withColumn("is_copy", F.col(key) != F.col("first_key")).select(*[F.col(f"`{c}`") for c in rows.columns], "first_key", "is_copy")


def _known(spark: SparkSession, root: str, batch: int, asked: DataFrame, sizes: Sequence[int]) -> DataFrame | None:
    """digest, first of the contents of this batch that came before, from the registry; None for the first batch."""
    if not sizes:
        return None
    earlier = [f"batch={k}" for k in range(batch)]
    possibly_known(asked, spark.read.parquet(*[f"{root}/filters/{b}" for b in earlier]), sizes).write.mode("overwrite").parquet(f"{root}/hits/batch={batch}")
    hits = spark.read.parquet(f"{root}/hits/batch={batch}").select("digest")
    hits = F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits
    spark.read.parquet(*[f"{root}/contents/{b}" for b in earlier]).join(hits, "digest", "left_semi").write.mode("overwrite").parquet(
        f"{root}/known/batch={batch}")
    return spark.read.parquet(f"{root}/known/batch={batch}")
