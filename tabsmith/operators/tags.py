"""Tags: cells that hold several values, exploded on read."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.text import as_text, non_blank_tokens
from tabsmith.operators.cleaning import column
from tabsmith.operators.edits import VALUES_LIMIT

OTHER = "Other"


@dataclass(frozen=True)
class TagConfig:
    prefix_separator: str | None = None
    tag_separator: str = ","
    vocabulary: Sequence[str] = ()
    include_other: bool = False


def strip_prefix(text: Column, separator: str | None) -> Column:
    """What follows the first separator; the whole text where there is none."""
    if not separator:
        return text
    at = F.instr(text, separator)
    return F.when(at > 0, F.substr(text, at + len(separator))).otherwise(text)


def explode_tags(df: DataFrame, name: str, config: TagConfig = TagConfig(), keep: Sequence[str] = ()) -> DataFrame:
    """One row per mention (a tag twice in a cell gives two rows), with the columns named in ``keep``."""
    text = strip_prefix(as_text(column(name), df.schema[name].dataType), config.prefix_separator)
    tokens = non_blank_tokens(text, config.tag_separator or ",")
    return df.select(*[column(c) for c in keep], F.explode(tokens).alias("tag"))


def tag_counts(df: DataFrame, name: str, config: TagConfig = TagConfig(), limit: int | None = VALUES_LIMIT) -> DataFrame:
    counts = explode_tags(df, name, config).groupBy("tag").agg(F.count(F.lit(1)).alias("count"))
    return counts if limit is None else counts.orderBy(F.desc("count"), "tag").limit(limit)


def tag_distinct_count(df: DataFrame, name: str, config: TagConfig = TagConfig()) -> DataFrame:
    return explode_tags(df, name, config).agg(F.count_distinct("tag").alias("distinct_count"))


def tag_label(tag: Column, config: TagConfig) -> Column:
    """The chart category of a tag: NULL when a vocabulary leaves it out."""
    if not config.vocabulary:
        return tag
    listed = F.when(tag.isin(*config.vocabulary), tag)
    return F.coalesce(listed, F.lit(OTHER)) if config.include_other else listed


def tag_chart(df: DataFrame, name: str, config: TagConfig = TagConfig()) -> DataFrame:
    tags = explode_tags(df, name, config).select(tag_label(F.col("tag"), config).alias("category"))
    counts = tags.filter("category IS NOT NULL").groupBy("category").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "category")
