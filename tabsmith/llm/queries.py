"""Registered queries of this subpackage: each operator over its whole table, with production parameters."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm import (
    chat, decontaminate, divergence, extract, lattice, lines, packing, phrases, rules, secrets, simhash, tokens, warc,
)
from tabsmith.llm.common import shared_folder, ship
from tabsmith.llm.oracles import CONTROL_TEXT, ORACLES

__all__ = ["ORACLES", "QUERIES"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_tokens(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), shared_folder(spark))
    return warc.read_archives(manifest).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "error"
    )


def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % lattice.FOLDS
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold == lattice.HELD_OUT)
    return lattice.score_documents(docs, component="lang")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"))).drop("row")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op6_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.report(found)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract.extract_text(pages, extract.fit(pages))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.report(rules.judge(table(spark, sf_dir, "documents")))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = rows.sparkSession.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(
        *[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role")) for k, role in enumerate(("user", "assistant"))]
    )).alias("t")).select("conv_id", "t.turn", "t.role", F.lit(CONTROL_TEXT).alias("text"))
    records = chat.as_records(rows.unionByName(planted))
    return chat.report(chat.format_turns(chat.canonical_turns(records)), "conv_id")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_section_tokens, op2_warc, op3_lattice, op4_pack, op5_simhash, op6_site_lines, op7_decontaminate, op8_main_text,
    op9_quality, op10_chat, op11_secrets, op12_phrases, op13_divergence,
)}
