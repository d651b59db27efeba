"""Column-name expressions: word split, human alias, identifier heuristic."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name words that mark an identifier rather than a quantity.
IDENTIFIER_WORDS = (
    "id", "code", "zip", "zipcode", "postal", "postalcode", "pin", "pincode", "phone", "phonenumber",
    "ssn", "isbn", "sku", "ein", "vin",
)

# Abbreviations spelt out in an alias.
ABBREVIATIONS = {
    "id": "ID", "dob": "Date of Birth", "amt": "Amount", "qty": "Quantity", "num": "Number", "no": "Number",
    "desc": "Description", "addr": "Address", "txn": "Transaction", "cust": "Customer", "emp": "Employee",
    "dept": "Department", "org": "Organization", "pct": "Percentage", "avg": "Average", "min": "Minimum",
    "max": "Maximum", "std": "Standard", "dt": "Date", "yr": "Year", "mo": "Month", "qtr": "Quarter",
    "rev": "Revenue", "nm": "Name", "phn": "Phone", "tel": "Phone",
}


# Where a column header is cut into words.
SEPARATORS, CASE_CHANGE = r"[_\-.]+", r"(?<=[a-z0-9])(?=[A-Z])"


def name_words(name: Column) -> Column:
    """Words of a column header: split at ``_``, ``-``, ``.``, blanks and lower-to-upper changes."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"^\s+|\s+$", ""), SEPARATORS, " ")
    return F.filter(F.split(F.regexp_replace(spaced, CASE_CHANGE, " "), " "), lambda w: w != "")


def looks_like_identifier(name: Column) -> Column:
    words = F.transform(name_words(name), F.lower)
    return F.arrays_overlap(words, F.lit(list(IDENTIFIER_WORDS)))


def alias_of(name: Column) -> Column:
    """``cust_dob`` to ``Customer Date of Birth``; an all-capitals word of up to five letters stays."""
    spelt_out = F.map_from_arrays(F.lit(list(ABBREVIATIONS)), F.lit(list(ABBREVIATIONS.values())))

    def label(word: Column) -> Column:
        acronym = (word == F.upper(word)) & (word != F.lower(word)) & (F.length(word) <= 5)
        return F.coalesce(
            spelt_out[F.lower(word)],
            F.when(acronym, word),
            F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2))),
        )

    words = name_words(name)
    return F.when(F.size(words) == 0, name).otherwise(F.array_join(F.transform(words, label), " "))
