"""Column-level building blocks: every function here takes and returns Columns."""
from tabsmith.functions.dates import DATE_FORMATS, parse_date
from tabsmith.functions.names import alias_of, looks_like_identifier, name_words
from tabsmith.functions.numbers import (
    is_plain_number,
    looks_like_money,
    parse_numeric_string,
    round_tenths,
    to_double,
)
from tabsmith.functions.text import (
    NULL_TOKENS,
    as_text,
    literal_split,
    non_blank_tokens,
    nullify,
    regex_replace_all,
)

__all__ = [
    "DATE_FORMATS", "NULL_TOKENS", "alias_of", "as_text", "is_plain_number", "literal_split",
    "looks_like_identifier", "looks_like_money", "name_words", "non_blank_tokens", "nullify",
    "parse_date", "parse_numeric_string", "regex_replace_all", "round_tenths", "to_double",
]
