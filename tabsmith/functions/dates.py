"""Date parsing expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTH, _DAY = r"(0?[1-9]|1[0-2])", r"(0?[1-9]|[12]\d|3[01])"
_CLOCK = r"([01]?\d|2[0-3]):[0-5]?\d:[0-5]?\d"

# The accepted date formats in the order they are tried, each with the shape a text
# must have. The shape keeps the parser from failing (slowly) on most texts of another format.
DATE_FORMATS = (
    ("yyyy-M-d H:m:s", rf"^\d{{4}}-{_MONTH}-{_DAY} {_CLOCK}$"),
    ("yyyy-M-d", rf"^\d{{4}}-{_MONTH}-{_DAY}$"),
    ("yyyy/M/d", rf"^\d{{4}}/{_MONTH}/{_DAY}$"),
    ("M/d/yyyy", rf"^{_MONTH}/{_DAY}/\d{{4}}$"),
    ("d/M/yyyy", rf"^{_DAY}/{_MONTH}/\d{{4}}$"),
    ("M-d-yyyy", rf"^{_MONTH}-{_DAY}-\d{{4}}$"),
    ("d-M-yyyy", rf"^{_DAY}-{_MONTH}-\d{{4}}$"),
    ("MMMM d, yyyy", rf"^[A-Za-z]{{3,9}} {_DAY}, \d{{4}}$"),
    ("MMM d, yyyy", rf"^[A-Za-z]{{3}} {_DAY}, \d{{4}}$"),
)


def parse_date(col: Column, day_first: bool = False) -> Column:
    """Text in any of the formats to a date, NULL if none fits; time of day is dropped.

    Month-first wins over day-first where both fit; ``day_first`` turns that round.
    """
    formats = list(DATE_FORMATS)
    if day_first:
        formats.sort(key=lambda f: not f[0].startswith(("yyyy", "d")))
    text = F.trim(col)

    def first_of(*starts: str) -> Column:
        tried = [(pattern, shape) for pattern, shape in formats if pattern.startswith(starts)]
        return F.coalesce(*[F.when(text.rlike(shape), F.try_to_date(text, pattern)) for pattern, shape in tried])

    # Comparing one or two characters first spares most texts all of the regular expressions.
    by_kind = (
        F.when(F.substring(text, 5, 1).isin("-", "/"), F.coalesce(first_of("yyyy"), first_of("M/", "d/", "M-", "d-")))
        .when(F.substring(text, 1, 1).between("0", "9"), first_of("M/", "d/", "M-", "d-"))
        .otherwise(first_of("MMM"))
    )
    return F.when(F.length(text).between(8, 19) & F.substring(text, -1, 1).between("0", "9"), by_kind)
