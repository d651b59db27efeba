"""Lookup join that stays balanced when one key holds a large share of the rows.

AQE's skew-join split does not help where the lookup side comes straight from a groupBy on the join
keys (there is an aggregate between its shuffle and the join), hence the explicit salting.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32
# A key is heavy when it has more than one in HEAVY_SHARE rows (so there are fewer heavy keys than
# that, which bounds the broadcast below) and enough rows to be worth a split.
HEAVY_SHARE = 1000
HEAVY_ROWS = 100_000


def free_names(names: Sequence[str], *tables: DataFrame) -> list[str]:
    """``names`` with as many underscores in front as it takes for none of them to be a column."""
    taken = {c.lower() for df in tables for c in df.columns}
    prefix = ""
    while any((prefix + n).lower() in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]


def _column(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def heavy_keys(df: DataFrame, keys: Sequence[str], min_rows: int = HEAVY_ROWS) -> DataFrame:
    """The keys that hold more than a thousandth of all rows: always fewer than a thousand rows."""
    [rows] = free_names(["_rows"], df)
    counts = df.groupBy(*map(_column, keys)).agg(F.count(F.lit(1)).alias(rows))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.filter((F.col(rows) > min_rows) & (F.col(rows) * HEAVY_SHARE > total)).select(*map(_column, keys))


def spread_lookup(
    df: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "left",
    min_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Left or inner join to a table with at most one row per key.

    Rows of a heavy key are dealt to ``SALTS`` tasks by a hash of ``spread_by`` (columns that differ
    between such rows), against one copy of its lookup row per salt; all other keys join as they are.
    A hash, not a random number, so that a task run again after a lost executor deals the same way.
    """
    flag, salt = free_names(["_heavy", "_salt"], df, lookup)
    heavy = F.broadcast(heavy_keys(df, keys, min_rows).withColumn(flag, F.lit(True)))
    missing = reduce(or_, [_column(k).isNull() for k in keys])
    dealt = F.pmod(F.xxhash64(*map(_column, spread_by)), F.lit(SALTS)).cast("int")
    all_salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    salted = df.join(heavy, list(keys), "left").withColumn(salt, F.when(F.col(flag) | missing, dealt).otherwise(0))
    copies = lookup.join(heavy, list(keys), "left").withColumn(
        salt, F.explode(F.when(F.col(flag), all_salts).otherwise(F.array(F.lit(0))))
    )
    return salted.drop(flag).join(copies.drop(flag), [*keys, salt], how).drop(salt)
