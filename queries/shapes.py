"""Tags and ranges."""
from __future__ import annotations

from pyspark.sql import functions as F

from queries.common import table
from tabsmith.operators import ranges, tags
from tabsmith.operators.ranges import RangeConfig
from tabsmith.operators.tags import TagConfig

QUERIES, ORACLES = {}, {}

WORDS = TagConfig(tag_separator=" ")
PREFIXED = TagConfig(prefix_separator="-", tag_separator="|")


def explode_tags(spark, sf):
    return tags.explode_tags(table(spark, sf, "part"), "p_name", WORDS, keep=["p_partkey"])


QUERIES["explode_tags"] = explode_tags
ORACLES["explode_tags"] = "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS tag FROM part"

QUERIES["tag_counts"] = lambda spark, sf: tags.tag_counts(table(spark, sf, "part"), "p_name", WORDS, 8)
ORACLES["tag_counts"] = """
SELECT tag, count(*) AS count FROM (SELECT trim(unnest(string_split(p_name, ' '))) AS tag FROM part)
WHERE tag <> '' GROUP BY ALL ORDER BY count DESC, tag LIMIT 8
"""
QUERIES["tag_counts_text"] = lambda spark, sf: tags.tag_counts(table(spark, sf, "documents"), "text", TagConfig(tag_separator=","), 50)
ORACLES["tag_counts_text"] = """
SELECT tag, count(*) AS count FROM (SELECT trim(unnest(string_split(text, ','))) AS tag FROM documents)
WHERE tag <> '' GROUP BY ALL ORDER BY count DESC, tag LIMIT 50
"""
QUERIES["tag_distinct"] = lambda spark, sf: tags.tag_distinct_count(table(spark, sf, "documents"), "text", TagConfig(tag_separator="."))
ORACLES["tag_distinct"] = """
SELECT count(DISTINCT tag) AS distinct_count FROM (SELECT trim(unnest(string_split(text, '.'))) AS tag FROM documents)
WHERE tag <> ''
"""


def _places(spark, sf):
    """Cells such as "1-URGENT| O | |P" with a prefix before the first dash; some are NULL."""
    cell = F.concat_ws("|", "o_orderpriority", F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")), F.lit(" "), F.lit("a-b"))
    return table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 10 != 0, cell).alias("cell"))


_PLACES_SQL = """
SELECT CASE WHEN o_orderkey % 10 <> 0 THEN concat_ws('|', o_orderpriority, ' ' || o_orderstatus || ' ', ' ', 'a-b') END AS cell
FROM orders
"""
_MENTIONS_SQL = f"""
SELECT trim(unnest(string_split(substr(cell, strpos(cell, '-') + 1), '|'))) AS tag FROM ({_PLACES_SQL}) WHERE cell IS NOT NULL
"""

QUERIES["tag_prefix"] = lambda spark, sf: tags.tag_chart(_places(spark, sf), "cell", PREFIXED)
ORACLES["tag_prefix"] = f"SELECT tag AS category, count(*) AS count FROM ({_MENTIONS_SQL}) WHERE tag <> '' GROUP BY ALL"


def tag_chart_vocab(spark, sf):
    return tags.tag_chart(_places(spark, sf), "cell", TagConfig("-", "|", ["URGENT", "O", "absent"]))


QUERIES["tag_chart_vocab"] = tag_chart_vocab
ORACLES["tag_chart_vocab"] = f"""
SELECT tag AS category, count(*) AS count FROM ({_MENTIONS_SQL}) WHERE tag IN ('URGENT', 'O', 'absent') GROUP BY ALL
"""


def tag_chart_other(spark, sf):
    return tags.tag_chart(_places(spark, sf), "cell", TagConfig("-", "|", ["URGENT", "O"], include_other=True))


QUERIES["tag_chart_other"] = tag_chart_other
ORACLES["tag_chart_other"] = f"""
SELECT CASE WHEN tag IN ('URGENT', 'O') THEN tag ELSE 'Other' END AS category, count(*) AS count
FROM ({_MENTIONS_SQL}) WHERE tag <> '' GROUP BY ALL
"""


def _spans(spark, sf):
    """Range text with a unit, some with decimals, a missing end or a suffix that only looks numeric."""
    low, high = F.col("p_size"), F.col("p_size") + 10
    span = (
        F.when(F.col("p_partkey") % 5 == 0, F.concat(low, F.lit(".5 - "), high, F.lit("yrs")))
        .when(F.col("p_partkey") % 11 == 0, F.concat(low, F.lit("+ yrs")))
        .when(F.col("p_partkey") % 13 == 0, F.concat(low, F.lit("-"), high, F.lit("d")))
        .when(F.col("p_partkey") % 17 != 0, F.concat(low, F.lit("-"), high, F.lit(" yrs")))
    )
    return table(spark, sf, "part").select("p_partkey", span.alias("span"))


_SPANS_SQL = """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size || '.5 - ' || (p_size + 10) || 'yrs'
                       WHEN p_partkey % 11 = 0 THEN p_size || '+ yrs'
                       WHEN p_partkey % 13 = 0 THEN p_size || '-' || (p_size + 10) || 'd'
                       WHEN p_partkey % 17 <> 0 THEN p_size || '-' || (p_size + 10) || ' yrs' END AS span
FROM part
"""
_ENDS_SQL = f"""
SELECT p_partkey, span, TRY_CAST(trim(replace(split_part(span, '-', 1), 'yrs', '')) AS DOUBLE) AS lo,
       TRY_CAST(trim(replace(split_part(span, '-', 2), 'yrs', '')) AS DOUBLE) AS hi
FROM ({_SPANS_SQL})
"""


def range_parse(spark, sf):
    ends = {v: ranges.parse_range(F.col("span"), RangeConfig(unit="yrs", value_type=v)) for v in ("min", "max", "midpoint")}
    return _spans(spark, sf).select("p_partkey", *[c.alias(v) for v, c in ends.items()])


QUERIES["range_parse"] = range_parse
ORACLES["range_parse"] = f"SELECT p_partkey, lo AS min, hi AS max, (lo + hi) / 2 AS midpoint FROM ({_ENDS_SQL})"

QUERIES["range_preview"] = lambda spark, sf: ranges.range_preview(_spans(spark, sf), "span", RangeConfig(unit="yrs"), order_by=["p_partkey"])
ORACLES["range_preview"] = f"""
SELECT span AS raw, (lo + hi) / 2 AS parsed FROM ({_ENDS_SQL}) WHERE span IS NOT NULL ORDER BY p_partkey LIMIT 20
"""
QUERIES["range_preview_counts"] = lambda spark, sf: ranges.range_parse_counts(_spans(spark, sf), "span", RangeConfig(unit="yrs"))
ORACLES["range_preview_counts"] = f"SELECT count(lo + hi) AS parsed, count(span) AS total FROM ({_ENDS_SQL})"

QUERIES["range_histogram"] = lambda spark, sf: ranges.range_histogram(_spans(spark, sf), "span", RangeConfig(unit="yrs"))
ORACLES["range_histogram"] = f"""
WITH v AS (SELECT (lo + hi) / 2 AS x FROM ({_ENDS_SQL}) WHERE lo + hi IS NOT NULL),
b AS (SELECT min(x) AS min_val, max(x) AS max_val FROM v)
SELECT CAST(CASE WHEN x = max_val THEN 9 ELSE floor((x - min_val) / (max_val - min_val) * 10) END AS INTEGER) AS bucket,
       count(*) AS count, min_val, max_val
FROM v, b GROUP BY ALL
"""
