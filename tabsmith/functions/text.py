"""Text expressions."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.patterns import PatternError, java_pattern, java_replacement, parse

__all__ = [
    "NULL_TOKENS", "PatternError", "as_text", "java_pattern", "literal_split", "non_blank_tokens", "nullify", "regex_replace_all",
]

# Tokens that stand for a missing value (exact, case-sensitive).
NULL_TOKENS = (
    "", "NA", "N/A", "n/a", "null", "NULL", "None", "none", "-", "--", "?", "unknown", "Unknown", "N.A.",
)


def nullify(col: Column) -> Column:
    """NULL where the text is one of the sentinel tokens."""
    return F.when(~col.isin(*NULL_TOKENS), col)


def literal_split(col: Column, separator: str) -> Column:
    """Split on a literal separator (Spark's split takes a regular expression)."""
    return F.split(col, re.sub(r"([^\w\s])", r"\\\1", separator))


def non_blank_tokens(col: Column, separator: str) -> Column:
    """The trimmed, non-empty pieces of a cell."""
    return F.filter(F.transform(literal_split(col, separator), lambda t: F.trim(t)), lambda t: t != "")


def regex_replace_all(col: Column, pattern: str, replacement: str) -> Column:
    r"""Replace every match of an RE2 pattern. The replacement is in the ``\1`` style; ``$`` is an ordinary character there.

    What RE2 refuses, or Java has no equal for, raises `PatternError` here, before any job.
    """
    return F.regexp_replace(col, F.lit(java_pattern(pattern)), F.lit(java_replacement(replacement, parse(pattern)[1])))


def as_text(col: Column, data_type: T.DataType) -> Column:
    """A value's text form. Doubles stay in positional notation between 1e-4 and 1e16 (Spark's cast
    turns to exponents from 1e7 on), so rules written against displayed values match."""
    if not isinstance(data_type, (T.DoubleType, T.FloatType)):
        if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(col)
        return col.cast("string")
    text, size = col.cast("string"), F.abs(col)
    digits = F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), r"(\.\d+?)0*$", "$1")
    exponent = F.regexp_extract(text, r"E(-?\d+)$", 1)
    scientific = F.concat(
        F.regexp_replace(F.regexp_extract(text, r"^(-?[\d.]+)E", 1), r"\.0$", ""),
        F.when(exponent.startswith("-"), "e-").otherwise("e+"),
        F.regexp_replace(F.regexp_replace(exponent, "-", ""), r"^(\d)$", "0$1"),
    )
    return (
        F.when(~text.contains("E"), text)
        .when((size >= 1e-4) & (size < 1e16), digits)
        .otherwise(scientific)
    )
