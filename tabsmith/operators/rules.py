"""Edit rules of a whole catalog of datasets, as tables.

Merge rules:       dataset, column, target, source, seq, rows_affected   (one row per source)
Replacement rules: dataset, column, find, replace, is_regex, seq, rows_affected

``seq`` orders the rules of a column. A new batch must carry larger numbers than the stored rules.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.operators.lookup import spread_lookup

COLUMN_KEY = ["dataset", "column"]
RULE_KEY = ["dataset", "column", "target"]
SOURCE_KEY = ["dataset", "column", "source"]


def validate_groups(groups: DataFrame, values: DataFrame) -> DataFrame:
    """Proposed groups (dataset, column, target, source, ...) cut down to sources that exist.

    ``values`` lists what occurs: dataset, column, value. Groups without a target or a known source
    leave no row.
    """
    proposed = groups.filter(F.trim("target") != "").withColumn("target", F.trim("target"))
    # Each value stands once on this side, and a source in as many groups as were proposed with it.
    occurring = values.select("dataset", "column", F.col("value").alias("source")).distinct()
    return proposed.join(occurring, SOURCE_KEY, "left_semi").select(*groups.columns)


def add_merges(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Accept a batch of merge groups (same columns as the rules; ``rows_affected`` is the group's).

    A source claimed by the batch leaves the rule that had it, and a rule without sources is gone.
    A group whose target has a rule joins it (its place kept, sources united, rows added up); else
    it becomes a new rule.
    """
    # Rules have one row per source, so no key is heavy here.
    kept = rules.join(new.select(*SOURCE_KEY).distinct(), SOURCE_KEY, "left_anti").select(*rules.columns)
    # Rule level: rows per (dataset, column, target), each group of the batch counted once.
    old_heads = kept.groupBy(*RULE_KEY).agg(F.min("seq").alias("seq"), F.max("rows_affected").alias("rows"))
    new_heads = (
        new.groupBy(*RULE_KEY, "seq").agg(F.max("rows_affected").alias("rows"))
        .groupBy(*RULE_KEY).agg(F.min("seq").alias("seq"), F.sum("rows").alias("rows"))
    )
    heads = (
        old_heads.unionByName(new_heads).groupBy(*RULE_KEY)
        .agg(F.min("seq").alias("seq"), F.sum("rows").cast("bigint").alias("rows_affected"))
    )
    sources = kept.select(*RULE_KEY, "source").unionByName(new.select(*RULE_KEY, "source")).distinct()
    return spread_lookup(sources, heads, RULE_KEY, ["source"], "inner").select(*RULE_KEY, "source", "seq", "rows_affected")


def winning_merges(rules: DataFrame) -> DataFrame:
    """One target per source: where one batch named a source twice, its first rule applies."""
    return rules.groupBy(*SOURCE_KEY).agg(F.min_by("target", "seq").alias("target"))


def add_replacement(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Accept replacements; one with a known ``find`` overwrites that rule and moves to the end."""
    latest = F.max_by(F.struct("replace", "is_regex", "seq", "rows_affected"), "seq").alias("rule")
    return (
        rules.unionByName(new).groupBy("dataset", "column", "find").agg(latest)
        .select("dataset", "column", "find", "rule.*")
    )


def _revert(rules: DataFrame, match: Column, what: str) -> DataFrame:
    if rules.filter(match).isEmpty():
        raise KeyError(f"No {what} matches.")
    return rules.filter(~match)


def revert_merge(rules: DataFrame, dataset: str, column: str, target: str) -> DataFrame:
    match = (F.col("dataset") == dataset) & (F.col("column") == column) & (F.col("target") == target)
    return _revert(rules, match, f"merge rule for {target!r}")


def revert_replacement(rules: DataFrame, dataset: str, column: str, find: str) -> DataFrame:
    match = (F.col("dataset") == dataset) & (F.col("column") == column) & (F.col("find") == find)
    return _revert(rules, match, f"replacement rule for {find!r}")


def apply_merge_table(df: DataFrame, rules: DataFrame, value: str = "value") -> DataFrame:
    """Merge values of a catalog-wide table (dataset, column, <value>) by stored rules, as one join."""
    targets = winning_merges(rules).withColumnRenamed("source", value)
    others = [c for c in df.columns if c not in ("dataset", "column", value)]
    joined = spread_lookup(df, targets, ["dataset", "column", value], others or [value])
    return joined.withColumn(value, F.coalesce("target", value)).select(*df.columns)
