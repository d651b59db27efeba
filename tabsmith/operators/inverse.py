"""Filters on edited values as filters on stored ones.

A replacement can't be undone by rule, but a column's stored values can be listed once: its dictionary. The edits go
over the dictionary instead of the rows, and the stored values that come out as wanted (the inverse image) become a list
that the Parquet scan can use, or a semi join between the least and the greatest of them where they are too many for a
list. The dictionary of a stored dataset never goes out of date, since stored data never changes.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.text import as_text
from tabsmith.operators.cleaning import column
from tabsmith.operators.edits import EditRules, apply_edits
from tabsmith.operators.lookup import free_names, spread_lookup

# Up to this many stored values a filter is a list in the scan.
LIST_VALUES = 1000
# Types whose values are the same after a trip through the driver; other ones are always joined.
LISTED = (T.StringType, T.IntegralType, T.DecimalType, T.FractionalType, T.DateType, T.TimestampNTZType, T.BooleanType)


def value_dictionary(df: DataFrame, name: str) -> DataFrame:
    """value, rows: the distinct stored values of a column in their own type, null among them.

    Zero and minus zero are one value to a grouping but two texts to an edit, so both are listed.
    """
    data_type = df.schema[name].dataType
    keys = [column(name).alias("value")]
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        keys.append(as_text(column(name), data_type).alias("_text"))
        signed = F.when(F.col("_text") == "-0.0", F.lit(-0.0).cast(data_type)).otherwise(F.col("value")).alias("value")
        return df.select(*keys).groupBy("value", "_text").agg(F.count(F.lit(1)).alias("rows")).select(signed, "rows")
    return df.select(*keys).groupBy("value").agg(F.count(F.lit(1)).alias("rows"))


def _place(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/column-{quote(name, safe='')}"


def write_dictionaries(df: DataFrame, names: Sequence[str], path: str) -> str:
    """Stores the dictionaries of columns below ``path``, each in value order."""
    for name in names:
        value_dictionary(df, name).sort("value").write.mode("errorifexists").parquet(_place(path, name))
    return path


def open_dictionary(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(_place(path, name))


def edited_dictionary(dictionary: DataFrame, rules: EditRules, name: str) -> DataFrame:
    """value, rows, edited: what each stored value reads as."""
    own = EditRules({name: rules.merges.get(name, ())}, {name: rules.replacements.get(name, ())})
    # The edits are made on a second copy of the values, under the column's name.
    kept, rows = free_names(["_value", "_rows"], dictionary.select(column("value").alias(name)))
    copied = dictionary.select(F.col("value").alias(kept), F.col("rows").alias(rows), F.col("value").alias(name))
    return apply_edits(copied, own).select(F.col(kept).alias("value"), F.col(rows).alias("rows"), column(name).alias("edited"))


def inverse_image(dictionary: DataFrame, rules: EditRules, name: str, wanted: Callable[[Column], Column]) -> DataFrame:
    """The stored values whose edited form is ``wanted``."""
    return edited_dictionary(dictionary, rules, name).filter(wanted(F.col("edited"))).select("value")


def filter_stored(
    df: DataFrame, rules: EditRules, name: str, wanted: Callable[[Column], Column], dictionary: DataFrame, list_values: int = LIST_VALUES
) -> DataFrame:
    """The rows of the stored data that may read as ``wanted``: all that do, none else but a zero of the other sign.

    One job over the dictionary, or two if there are more values than ``list_values``.
    """
    data_type = df.schema[name].dataType
    image = inverse_image(dictionary, rules, name, wanted)
    found = [r[0] for r in image.limit(list_values + 1).collect()] if isinstance(data_type, LISTED) else None
    if found is not None and len(found) <= list_values:
        return df.filter(_listed(column(name), found, data_type))
    [key] = free_names(["_value"], df)
    bounds = image.agg(F.min("value"), F.max("value"), F.count_if(F.col("value").isNull()).alias("nulls")).first()
    stored = df
    if found is not None and not isinstance(data_type, (T.DoubleType, T.FloatType)):  # a NaN has no place between bounds
        low, high = (F.lit(v).cast(data_type) for v in bounds[:2])
        stored = stored.filter(column(name).between(low, high))
    spread = [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType)]
    met = spread_lookup(stored.withColumn(key, column(name)), image.select(F.col("value").alias(key)).filter(F.col(key).isNotNull()).distinct(),
                        [key], spread, "left_semi").select(*[column(c) for c in df.columns])
    return met.unionByName(df.filter(column(name).isNull())) if bounds["nulls"] else met


def _listed(stored: Column, values: Sequence[object], data_type: T.DataType) -> Column:
    nan = any(isinstance(v, float) and math.isnan(v) for v in values)
    zero = any(isinstance(v, float) and v == 0 for v in values)
    plain = [F.lit(v).cast(data_type) for v in values if v is not None and not (isinstance(v, float) and (v == 0 or math.isnan(v)))]
    parts = [stored.isin(plain)] if plain else []
    # Not by an equality: Catalyst would put the literal's sign in place of the stored one.
    parts += [(stored >= F.lit(0.0)) & (stored <= F.lit(0.0))] if zero else []
    # Statistics of Parquet files know no NaN: this part keeps the whole condition out of them.
    parts += [F.isnan(stored)] if nan else []
    parts += [stored.isNull()] if None in values else []
    return reduce(or_, parts, F.lit(False)) if parts else F.lit(False)


def filter_edited(
    df: DataFrame, rules: EditRules, name: str, wanted: Callable[[Column], Column], dictionary: DataFrame, list_values: int = LIST_VALUES
) -> DataFrame:
    """The edited rows whose value of a column is ``wanted``; ``df`` is the stored data."""
    stored = filter_stored(df, rules, name, wanted, dictionary, list_values)
    return apply_edits(stored, rules).filter(wanted(column(name)))
