"""Read-time value edits: replacements first, in rule order, then whole-value merges.

Stored data never changes. A column with a rule reads as text; dropping the rule brings the native
type back. Everything is a Column expression, so unused edited columns are pruned by Catalyst.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.text import as_text, regex_replace_all
from tabsmith.operators.cleaning import column
from tabsmith.operators.lookup import free_names, spread_lookup

# Above this number of merged values an edit becomes a join with the rules, since an expression
# with thousands of literals is slow to compile.
INLINE_SOURCES = 200
# A rule list of up to this many text bytes is sent to every task; a longer one is joined by shuffle.
BROADCAST_BYTES = 8 * 1024 * 1024
# Fixed value: size of a value list where none is asked for.
VALUES_LIMIT = 200


@dataclass(frozen=True)
class Replacement:
    find: str
    replace: str
    is_regex: bool = False


@dataclass(frozen=True)
class Merge:
    target: str
    sources: Sequence[str]


@dataclass(frozen=True)
class EditRules:
    """Rules per column name."""

    merges: Mapping[str, Sequence[Merge]] = field(default_factory=dict)
    replacements: Mapping[str, Sequence[Replacement]] = field(default_factory=dict)

    def __bool__(self) -> bool:
        return any(self.merges.values()) or any(self.replacements.values())

    def with_merge(self, name: str, *merges: Merge) -> EditRules:
        return EditRules({**self.merges, name: [*self.merges.get(name, ()), *merges]}, self.replacements)

    def with_replacement(self, name: str, rule: Replacement) -> EditRules:
        kept = [r for r in self.replacements.get(name, ()) if r.find != rule.find]
        return EditRules(self.merges, {**self.replacements, name: [*kept, rule]})


def replaced(text: Column, rule: Replacement) -> Column:
    if rule.is_regex:
        return regex_replace_all(text, rule.find, rule.replace)
    return F.replace(text, F.lit(rule.find), F.lit(rule.replace)) if rule.find else text


def _target_by_source(merges: Sequence[Merge]) -> dict[str, str]:
    """The first rule that names a source wins."""
    chosen: dict[str, str] = {}
    for rule in merges:
        for source in rule.sources:
            chosen.setdefault(source, rule.target)
    return chosen


def apply_edits(df: DataFrame, rules: EditRules) -> DataFrame:
    texts, inline, joined = {}, {}, {}
    for field_ in df.schema:
        name = field_.name
        targets = _target_by_source(rules.merges.get(name, ()))
        replacements = rules.replacements.get(name, ())
        if not targets and not replacements:
            continue
        text = as_text(column(name), field_.dataType)
        for rule in replacements:
            text = replaced(text, rule)
        texts[name] = text
        if len(targets) > INLINE_SOURCES:
            joined[name] = targets
        elif targets:
            inline[name] = _merged(column(name), targets)
    # Two projections: the replaced text is worked out once, then compared with the merge lists.
    df = df.withColumns(texts) if texts else df
    df = df.withColumns(inline) if inline else df
    for name, targets in joined.items():
        df = _merge_by_join(df, name, targets)
    return df


def raw_values(rules: EditRules, name: str, value: str) -> list[str] | None:
    """The stored texts that read as ``value`` under a column's merges; None if replacements forbid a list."""
    if rules.replacements.get(name):
        return None
    targets = _target_by_source(rules.merges.get(name, ()))
    return [*(s for s, t in targets.items() if t == value), *([value] if value not in targets else [])]


def _merged(text: Column, targets: Mapping[str, str]) -> Column:
    # One IN list per target; a source has one target only, so their order is free.
    by_target: dict[str, list[str]] = {}
    for source, target in targets.items():
        by_target.setdefault(target, []).append(source)
    return F.coalesce(*[F.when(text.isin(s), F.lit(t)) for t, s in by_target.items()], text)


def _merge_by_join(df: DataFrame, name: str, targets: Mapping[str, str]) -> DataFrame:
    source, target = free_names(["_source", "_target"], df)
    rules = df.sparkSession.createDataFrame(list(targets.items()), f"{source} string, {target} string")
    keyed = df.withColumn(source, column(name))
    if sum(len(s) + len(t) for s, t in targets.items()) * 2 <= BROADCAST_BYTES:
        merged = keyed.join(F.broadcast(rules), source, "left")
    else:
        spread = [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType)]
        merged = spread_lookup(keyed, rules, [source], spread)
    return merged.withColumn(name, F.coalesce(target, column(name))).select(*[column(c) for c in df.columns])


def _text_of(df: DataFrame, name: str) -> Column:
    return as_text(column(name), df.schema[name].dataType)


def value_counts(df: DataFrame, name: str, limit: int | None = VALUES_LIMIT) -> DataFrame:
    """The most frequent values as text; ties in value order. ``limit=None`` gives all of them."""
    text = _text_of(df, name).alias("value")
    counts = df.select(text).filter("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    if limit is None:
        return counts
    return counts.orderBy(F.desc("count"), "value").limit(limit)


def distinct_count(df: DataFrame, name: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(count(column(name)).alias("distinct_count"))


def replacement_effect(df: DataFrame, name: str, rule: Replacement) -> DataFrame:
    """Rows whose text would change (a match replaced by itself does not count)."""
    before = _text_of(df, name)
    return df.agg(F.count_if(~before.eqNullSafe(replaced(before, rule))).alias("rows_affected"))


def merge_effect(df: DataFrame, name: str, merges: Sequence[Merge]) -> DataFrame:
    """Rows each group would move, counted over the values as they read before the merge."""
    pairs = [(m.target, s) for m in merges for s in dict.fromkeys(m.sources)]
    groups = df.sparkSession.createDataFrame(pairs, "target string, value string")
    moved = F.when(F.col("value") != F.col("target"), F.col("count")).otherwise(0)
    # The counts hold one row per distinct value, so neither side has a heavy key.
    counts = value_counts(df, name, limit=None)
    if len(pairs) <= INLINE_SOURCES:
        counts = counts.filter(F.col("value").isin(sorted({s for _, s in pairs})))
    return (
        groups.join(counts, "value", "left")
        .groupBy("target")
        .agg(F.coalesce(F.sum(moved), F.lit(0)).cast("bigint").alias("rows_affected"))
    )


def preview_edit(df: DataFrame, name: str, edited: DataFrame) -> DataFrame:
    """Values before and after a trial edit of ``df``, with both counts (0 where a value is absent).

    `distinct_counts` has the number of values on both sides.
    """
    before = value_counts(df, name, limit=None).withColumnRenamed("count", "before")
    after = value_counts(edited, name, limit=None).withColumnRenamed("count", "after")
    return before.join(after, "value", "full").select(
        "value", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after")
    )


def distinct_counts(preview: DataFrame) -> DataFrame:
    """How many values there are before and after, from an edit preview."""
    return preview.agg(
        F.count_if(F.col("before") > 0).alias("distinct_before"), F.count_if(F.col("after") > 0).alias("distinct_after")
    )
