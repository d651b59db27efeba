"""Changes laid over profiles: saved configs, suggested and chosen categories, the review queue."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.operators.profile import CATEGORIES, REVIEW_BELOW

KEY = ["dataset", "name"]


def overlay_configs(profile_df: DataFrame, tags: DataFrame, ranges: DataFrame) -> DataFrame:
    """A saved config wins over the detected hint.

    ``tags``: dataset, name, tag_separator. ``ranges``: dataset, name, separator, unit. A blank
    separator stands for the default; a saved range's unit applies even if it is NULL. Of several rows for a
    column, the last by ``seq`` counts where there is such a column, else the greatest.
    """
    tag = _latest(tags, F.struct("tag_separator")).withColumnRenamed("_chosen", "_tag")
    span = _latest(ranges, F.struct("separator", "unit")).withColumnRenamed("_chosen", "_range")
    joined = profile_df.join(tag, KEY, "left").join(span, KEY, "left")
    saved = F.col("_range").isNotNull()
    default = lambda c, value: F.coalesce(F.nullif(c, F.lit("")), F.lit(value))
    return joined.withColumns({
        "multi_value_separator": F.when(F.col("_tag").isNotNull(), default(F.col("_tag.tag_separator"), ","))
        .otherwise(F.col("multi_value_separator")),
        "range_separator": F.when(saved, default(F.col("_range.separator"), "-")).otherwise(F.col("range_separator")),
        "range_unit": F.when(saved, F.col("_range.unit")).otherwise(F.col("range_unit")),
    }).select(*profile_df.columns)


def _latest(rows: DataFrame, fields: Column, *first: Column) -> DataFrame:
    """One row per column of a dataset: by ``first``, then by ``seq`` if it is there, then by the fields themselves."""
    order = [*first, *([F.col("seq")] if "seq" in rows.columns else []), fields]
    return rows.groupBy(*KEY).agg(F.max_by(fields, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_chosen"))


def review_queue(profile_df: DataFrame, names: Iterable[str] | DataFrame | None = None) -> DataFrame:
    """Columns waiting for a review, or exactly those asked for: names, or a (dataset, name) table."""
    if names is None:
        return profile_df.filter(F.col("needs_review") & (F.col("category_source") != "user"))
    if isinstance(names, DataFrame):
        return profile_df.join(names.select(*KEY).distinct(), KEY, "left_semi").select(*profile_df.columns)
    return profile_df.filter(F.col("name").isin(list(names)))


def apply_overrides(profile_df: DataFrame, overrides: DataFrame) -> DataFrame:
    """Suggested or chosen categories and aliases.

    ``overrides``: dataset, name, source ("ai" or "user"), category, confidence, rationale, alias;
    of several rows for a column a user's wins, then the last (as in `overlay_configs`). A suggestion needs a known category and a confidence, else it is
    passed over. A user's category is certain and clears the review; an alias changes nothing else.
    """
    known = F.col("category").isin(*CATEGORIES)
    usable = (
        ((F.col("source") == "user") & (F.col("category").isNull() | known))
        | ((F.col("source") == "ai") & known & F.col("confidence").isNotNull())
    )
    fields = F.struct("source", "category", "confidence", "rationale", "alias")
    chosen_rows = _latest(overrides.filter(usable), fields, F.col("source") == "user").withColumnRenamed("_chosen", "_o")
    joined = profile_df.join(chosen_rows, KEY, "left")
    user, ai = F.col("_o.source") == "user", F.col("_o.source") == "ai"
    chosen = user & F.col("_o.category").isNotNull()

    def pick(name: str, by_user, by_ai):
        return F.when(chosen, by_user).when(ai, by_ai).otherwise(F.col(name))

    return joined.select(*[
        {
            "category": pick("category", F.col("_o.category"), F.col("_o.category")),
            "category_source": pick("category_source", F.lit("user"), F.lit("ai")),
            "confidence": pick("confidence", F.lit(100.0), F.col("_o.confidence")),
            "needs_review": pick("needs_review", F.lit(False), F.col("_o.confidence") < REVIEW_BELOW),
            "rationale": pick("rationale", F.lit(None), F.col("_o.rationale")),
            "alias": F.when(user, F.coalesce("_o.alias", "alias")).otherwise(F.col("alias")),
        }.get(c, F.col(c)).alias(c)
        for c in profile_df.columns
    ])
