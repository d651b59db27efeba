"""Numeric parsing and rounding expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shape of a plain number, and of money, percent and thousands-separated text.
PLAIN_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
MONEY = r"^\s*-?\$?\s?(\d{1,3}(,\d{3})*|\d+)(\.\d+)?\s?%?\s*$"


def starts_like_number(col: Column) -> Column:
    """A cheap look at the first character that spares most texts the regular expressions below."""
    first = F.substring(F.ltrim(col), 1, 1)
    return first.between("0", "9") | first.isin("-", "+", ".", "$", "\t", "\n", "\r", "\f", "\x0b")


def is_plain_number(col: Column) -> Column:
    return starts_like_number(col) & col.rlike(PLAIN_NUMBER)


def to_double(col: Column) -> Column:
    """Text to double, NULL when it is not a plain number. The shape is checked first because the
    cast alone also takes Java suffixes such as ``1d`` or ``1f``."""
    return F.when(is_plain_number(col), F.trim(col).try_cast("double"))


def looks_like_money(col: Column) -> Column:
    return starts_like_number(col) & col.rlike(MONEY)


def parse_numeric_string(col: Column) -> Column:
    """``$1,037.50`` to 1037.5 and ``5%`` to 5.0."""
    plain = F.replace(F.replace(F.replace(col, F.lit("$")), F.lit(",")), F.lit("%"))
    return to_double(plain)


def round_tenths(col: Column, ties: str = "even") -> Column:
    """One decimal place, correctly rounded from the binary value; exact ties go to ``even`` or ``up``.

    Spark's ``round`` works on the shortest decimal text of a double, so that 85.35 (which is stored
    a little below 85.35) would go up. Here 20x is taken as 16x + 4x with its rounding error, and the
    remainder to the nearest midpoint decides.
    """
    x = col.cast("double")
    twenty = x * 16 + x * 4
    error = x * 4 - (twenty - x * 16)
    below = F.floor(twenty / 2).cast("double")
    past_middle = (twenty - (below * 2 + 1)) + error
    tie_goes_up = F.lit(True) if ties == "up" else F.pmod(below, F.lit(2.0)) == 1
    up = (past_middle > 0) | ((past_middle == 0) & tie_goes_up)
    return F.when(up, below + 1).otherwise(below) / 10
