"""From documents to packed training sequences, in five stages.

Quality rules drop documents, line dedup cuts lines that a source repeats, near dedup keeps one document of
each group of near copies, decontamination cuts benchmark passages (and drops documents that are mostly such), and
packing places the rest as token pieces. Each stage's result is written to the shared folder and read back.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabsmith.llm import decontaminate, lines, near_copies, packing, rules
from tabsmith.llm.common import saved, ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fences of their language and source."""
    return rules.passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that too many documents of their source contain."""
    return lines.without_boilerplate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles with a Jaccard similarity of 0.8 or more."""
    return near_copies.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly such go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in a training sequence."""
    return packing.pack(packing.token_pieces(docs)).drop("row")


STAGES = [
    ("quality_rules", quality), ("line_dedup", line_dedup), ("simhash_dedup", near_dedup),
    ("decontamination", decontamination), ("best_fit_packing", pack),
]
#: Subword tokens and fingerprints are beyond SQL; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
