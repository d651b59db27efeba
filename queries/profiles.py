"""Profiles, classification, hints, overrides and chart recommendations."""
from __future__ import annotations

from pyspark.sql import functions as F

from queries.common import choose, scratch, sql_choose, table
from tabsmith.functions.names import alias_of, looks_like_identifier
from tabsmith.operators import overrides, sketches
from tabsmith.operators import profile as profiles
from tabsmith.operators.ranges import RangeConfig
from tabsmith.operators.tags import TagConfig
from tabsmith.plans import charts as chart_plans
from tabsmith.plans import report

QUERIES, ORACLES = {}, {}

CORE = [
    "name", "type", "alias", "category", "confidence", "needs_review", "row_count", "null_count",
    "null_percentage", "distinct_count", "avg_length", "health_score",
]
_TENTHS = "CAST(format('{{:.1f}}', {}) AS DOUBLE)"


def tenths(expression: str) -> str:
    """One decimal from the exact binary value, which is what a formatted number gives."""
    return f"CAST(format('{{:.1f}}', CAST({expression} AS DOUBLE)) AS DOUBLE)"


def _kind(type_name: str) -> str:
    if type_name in ("int", "bigint", "double"):
        return "n"
    return {"string": "t", "boolean": "b"}.get(type_name, "d")


def counts_sql(columns: dict[str, str], source: str, key: str | None = None) -> str:
    """Counts of every column, per dataset if there is a key column. ``columns``: name to Spark type."""
    parts = []
    for i, (name, type_name) in enumerate(columns.items()):
        length = f"avg(length({name}))" if type_name == "string" else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT {f'CAST({key} AS VARCHAR)' if key else chr(39) + 'data' + chr(39)} AS dataset, '{name}' AS name, "
            f"'{type_name}' AS type, '{_kind(type_name)}' AS kind, {i} AS position, count(*) AS row_count, "
            f"count(*) - count({name}) AS null_count, count(DISTINCT {name}) AS distinct_count, {length} AS avg_length "
            f"FROM {source} {f'GROUP BY {key}' if key else ''}"
        )
    return "\nUNION ALL ".join(parts)


def profile_sql(counts: str, alias: str = "alias") -> str:
    """Category, confidence and health over counts; ``alias`` is an expression over the name."""
    n, d = "row_count", "distinct_count"
    ratio = f"({d} / {n})"
    number = tenths(f"60.0 + least(abs({d} - 20) / 20.0, 1.0) * 39.0")
    small = f"kind = 't' AND {d} <= greatest(50, {n} * 0.05) AND {ratio} <= 0.05"
    identifier = (
        "len(list_intersect(string_split(lower(regexp_replace(name, '[_.-]+', ' ', 'g')), ' '), "
        "['id', 'code', 'zip', 'sku', 'phone'])) > 0"
    )
    return f"""
SELECT dataset, name, type, {alias} AS alias, category, confidence, confidence < 70 AS needs_review, row_count, null_count,
       {tenths('null_count / row_count * 100')} AS null_percentage, distinct_count, avg_length,
       {tenths('(1 - null_count / row_count) * 100')} AS health_score, position
FROM (SELECT *,
    CASE WHEN kind = 'd' THEN 'datetime' WHEN kind = 'b' THEN 'categorical'
         WHEN kind = 'n' AND ({d} <= 20 OR {identifier}) THEN 'categorical'
         WHEN kind = 'n' THEN 'continuous_numerical'
         WHEN {small} THEN 'categorical' WHEN avg_length > 40 OR {ratio} > 0.5 THEN 'free_text'
         ELSE 'categorical' END AS category,
    CASE WHEN kind IN ('d', 'b') THEN 99.0
         WHEN kind = 'n' AND {d} > 20 AND {identifier} THEN 65.0 WHEN kind = 'n' THEN {number}
         WHEN {small} THEN {tenths(f'60.0 + least((0.05::DOUBLE - {ratio}) / 0.05::DOUBLE, 1.0) * 39.0')}
         WHEN avg_length > 40 THEN 85.0
         WHEN {ratio} > 0.5 THEN {tenths(f'60.0 + least(({ratio} - 0.5) / 0.5, 1.0) * 39.0')}
         ELSE 55.0 END AS confidence
  FROM ({counts}))
"""


def _title(name: str) -> str:
    """Aliases of the given tables' columns need no abbreviation but ID."""
    return " ".join("ID" if w == "id" else w[:1].upper() + w[1:] for w in name.split("_"))


def _aliases(columns) -> str:
    return "CASE name " + " ".join(f"WHEN '{c}' THEN '{_title(c)}'" for c in columns) + " END"


LINEITEM = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
    "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
DOCUMENTS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
ORDERS = {"o_orderkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


def _core_sql(columns, counts):
    return f"SELECT {', '.join(CORE)} FROM ({profile_sql(counts, _aliases(columns))})"


def _rounded(df):
    return df.withColumn("avg_length", F.round("avg_length", 6))


def _core(df):
    return _rounded(df.select(*CORE))


QUERIES["profile_lineitem"] = lambda spark, sf: _core(profiles.profile(table(spark, sf, "lineitem")))
ORACLES["profile_lineitem"] = (
    f"SELECT * REPLACE (round(avg_length, 6) AS avg_length) FROM ({_core_sql(LINEITEM, counts_sql(LINEITEM, 'lineitem'))})"
)
QUERIES["profile_documents"] = lambda spark, sf: _core(profiles.profile(table(spark, sf, "documents")))
ORACLES["profile_documents"] = (
    f"SELECT * REPLACE (round(avg_length, 6) AS avg_length) FROM ({_core_sql(DOCUMENTS, counts_sql(DOCUMENTS, 'documents'))})"
)


def profile_with_nulls(spark, sf):
    """Values missing at three rates."""
    k = F.col("o_orderkey")
    holes = table(spark, sf, "orders").select(
        F.when(k % 3 != 0, F.col("o_orderstatus")).alias("status"),
        F.when(k % 7 != 0, F.col("o_totalprice")).alias("price"),
        F.when(k < 0, F.col("o_orderdate")).alias("never"),
        (k % 2 == 0).alias("even"),
    )
    return _core(profiles.profile(holes))


_HOLES = {"status": "string", "price": "double", "never": "timestamp_ntz", "even": "boolean"}
_HOLES_SQL = """(SELECT CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS status,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price,
    CASE WHEN o_orderkey < 0 THEN o_orderdate END AS never, o_orderkey % 2 = 0 AS even FROM orders)"""
QUERIES["profile_with_nulls"] = profile_with_nulls
ORACLES["profile_with_nulls"] = (
    f"SELECT * REPLACE (round(avg_length, 6) AS avg_length) FROM ({_core_sql(_HOLES, counts_sql(_HOLES, _HOLES_SQL))})"
)


def profile_estimated(spark, sf):
    """The sketch-based profile: exact but for the distinct counts, which are left out here."""
    estimated = profiles.profile(table(spark, sf, "lineitem"), exact=False)
    return estimated.select("name", "type", "category", "row_count", "null_count", "health_score")


QUERIES["profile_estimated"] = profile_estimated
ORACLES["profile_estimated"] = (
    "SELECT name, type, category, row_count, null_count, health_score "
    f"FROM ({_core_sql(LINEITEM, counts_sql(LINEITEM, 'lineitem'))})"
)


# A catalog: the orders of every customer are a dataset of their own.
def _catalog(spark, sf):
    return profiles.profile(table(spark, sf, "orders"), by="o_custkey")


_CATALOG_SQL = profile_sql(counts_sql(ORDERS, "orders", "o_custkey"), _aliases(ORDERS))

QUERIES["profile_catalog"] = lambda spark, sf: _rounded(_catalog(spark, sf).select("dataset", *CORE))
ORACLES["profile_catalog"] = f"SELECT * EXCLUDE (position) REPLACE (round(avg_length, 6) AS avg_length) FROM ({_CATALOG_SQL})"

QUERIES["dataset_summary"] = lambda spark, sf: profiles.dataset_summary(_catalog(spark, sf))
ORACLES["dataset_summary"] = f"""
SELECT dataset, count(*) AS columns, max(row_count) AS row_count, {tenths('avg(health_score)')} AS health_score
FROM ({_CATALOG_SQL}) GROUP BY dataset
"""
QUERIES["dataset_health"] = lambda spark, sf: profiles.dataset_health(profiles.profile(
    table(spark, sf, "customer").withColumn("c_name", F.expr("CASE WHEN c_custkey % 3 > 0 THEN c_name END"))
))
ORACLES["dataset_health"] = f"""
WITH h AS (SELECT unnest([100.0, 100.0, 100.0, 100.0]) AS s UNION ALL
           SELECT {tenths('count(CASE WHEN c_custkey % 3 > 0 THEN c_name END) / count(*) * 100')} FROM customer)
SELECT {tenths('avg(s)')} AS health_score FROM h
"""

# Column names built from parts: the first word, a separator or a capital, the second word.
_FIRST, _SECOND = ["cust", "txn", "zip", "order", "user", "avg", "SKU", "x"], ["id", "code", "amt", "name", "no", "pct", "qtr"]
_JOINTS = ["_", "-", ".", ""]


def _names(spark, sf):
    k = F.col("p_partkey")
    second = F.when(k % 4 == 3, F.initcap(choose(_SECOND, F.floor(k / 3)))).otherwise(choose(_SECOND, F.floor(k / 3)))
    name = F.concat(choose(_FIRST, F.col("p_size")), choose(_JOINTS, k), second, F.lit("_"), F.lower("p_type"))
    return table(spark, sf, "part").select("p_partkey", name.alias("name"))


_NAMES_SQL = f"""
SELECT p_partkey, f || j || CASE WHEN j = '' THEN upper(s[1]) || s[2:] ELSE s END || '_' || lower(p_type) AS name
FROM (SELECT p_partkey, p_type, {sql_choose([f"'{w}'" for w in _FIRST], 'p_size')} AS f,
             {sql_choose([f"'{w}'" for w in _JOINTS], 'p_partkey')} AS j,
             {sql_choose([f"'{w}'" for w in _SECOND], 'p_partkey // 3')} AS s FROM part)
"""
_WORDS_SQL = r"""string_split(regexp_replace(regexp_replace(name, '[_.\-]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), ' ')"""


def aliases(spark, sf):
    return _names(spark, sf).select("p_partkey", "name", alias_of(F.col("name")).alias("alias"))


QUERIES["aliases"] = aliases
ORACLES["aliases"] = f"""
SELECT p_partkey, name, array_to_string(list_transform({_WORDS_SQL}, lambda w: CASE lower(w)
    WHEN 'id' THEN 'ID' WHEN 'amt' THEN 'Amount' WHEN 'no' THEN 'Number' WHEN 'pct' THEN 'Percentage'
    WHEN 'qtr' THEN 'Quarter' WHEN 'cust' THEN 'Customer' WHEN 'txn' THEN 'Transaction' WHEN 'avg' THEN 'Average'
    ELSE upper(w[1]) || w[2:] END), ' ') AS alias
FROM ({_NAMES_SQL})
"""


def identifier_columns(spark, sf):
    return _names(spark, sf).select("p_partkey", looks_like_identifier(F.col("name")).alias("is_identifier"))


QUERIES["identifier_columns"] = identifier_columns
ORACLES["identifier_columns"] = f"""
SELECT p_partkey, len(list_intersect(list_transform({_WORDS_SQL}, lambda w: lower(w)), ['id', 'code', 'zip', 'sku'])) > 0
       AS is_identifier
FROM ({_NAMES_SQL})
"""


def multi_value_detect(spark, sf):
    k = F.col("p_partkey")
    cells = table(spark, sf, "part").select(
        F.replace("p_name", F.lit(" "), F.lit(", ")).alias("commas"),
        F.when(k % 4 == 0, F.col("p_brand")).otherwise(F.replace("p_name", F.lit(" "), F.lit("|"))).alias("pipes"),
        F.when(k % 4 == 0, F.replace("p_name", F.lit(" "), F.lit(";"))).otherwise(F.col("p_brand")).alias("rare"),
        F.concat(F.col("p_type"), F.lit("/ /")).alias("blank_pieces"),
    )
    return profiles.profile(cells).select("name", "category", "multi_value_separator")


QUERIES["multi_value_detect"] = multi_value_detect
ORACLES["multi_value_detect"] = """
WITH c AS (SELECT replace(p_name, ' ', ', ') AS commas,
                  CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE replace(p_name, ' ', '|') END AS pipes,
                  CASE WHEN p_partkey % 4 = 0 THEN replace(p_name, ' ', ';') ELSE p_brand END AS rare,
                  p_type || '/ /' AS blank_pieces FROM part),
u AS (UNPIVOT c ON commas, pipes, rare, blank_pieces INTO NAME name VALUE v),
s AS (SELECT name, s, avg(CASE WHEN len(list_filter(string_split(v, s), lambda t: trim(t) <> '')) >= 2 THEN 1 ELSE 0 END) AS share
      FROM u, (VALUES (',', 1), (';', 2), ('|', 3), ('/', 4)) x(s, i) GROUP BY ALL),
d AS (SELECT name, count(DISTINCT v) AS d, count(*) AS n, avg(length(v)) AS len FROM u GROUP BY name),
p AS (SELECT name, min_by(s, list_position([',', ';', '|', '/'], s)) AS sep FROM s WHERE share >= 0.5 GROUP BY name),
k AS (SELECT name, CASE WHEN d <= greatest(50, n * 0.05) AND d / n <= 0.05 THEN 'categorical'
                        WHEN len > 40 OR d / n > 0.5 THEN 'free_text' ELSE 'categorical' END AS category FROM d)
SELECT name, category, CASE WHEN category = 'categorical' THEN sep END AS multi_value_separator
FROM k LEFT JOIN p USING (name)
"""


def range_detect(spark, sf):
    k, low = F.col("p_partkey"), F.col("p_size")
    spans = table(spark, sf, "part").select(
        F.concat(low, F.lit("-"), low + 10, F.when(k % 3 == 0, " yrs").otherwise(" months")).alias("units"),
        F.concat(low, F.lit(" - "), low + 1, F.lit(".5")).alias("bare"),
        F.when(k % 3 == 0, F.concat(low, F.lit("-"), low)).otherwise(F.col("p_name")).alias("mixed"),
        F.col("p_size").cast("string").alias("plain"),
    )
    return profiles.profile(spans).select("name", "range_separator", "range_unit")


QUERIES["range_detect"] = range_detect
ORACLES["range_detect"] = r"""
WITH c AS (SELECT p_size || '-' || (p_size + 10) || CASE WHEN p_partkey % 3 = 0 THEN ' yrs' ELSE ' months' END AS units,
                  p_size || ' - ' || (p_size + 1) || '.5' AS bare,
                  CASE WHEN p_partkey % 3 = 0 THEN p_size || '-' || p_size ELSE p_name END AS mixed,
                  CAST(p_size AS VARCHAR) AS plain FROM part),
u AS (UNPIVOT c ON units, bare, mixed, plain INTO NAME name VALUE v),
m AS (SELECT name, regexp_matches(v, '^\s*\d+(\.\d+)?\s*-\s*\d+(\.\d+)?\s*[A-Za-z]*\s*$') AS hit,
             nullif(regexp_extract(v, '([A-Za-z]*)\s*$', 1), '') AS unit FROM u),
r AS (SELECT name, avg(CAST(hit AS INT)) >= 0.5 AS yes FROM m GROUP BY name),
t AS (SELECT name, unit, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, unit) AS i
      FROM m WHERE hit AND unit IS NOT NULL GROUP BY name, unit)
SELECT name, CASE WHEN yes THEN '-' END AS range_separator, CASE WHEN yes THEN unit END AS range_unit
FROM r LEFT JOIN (SELECT * FROM t WHERE i = 1) USING (name)
"""

QUERIES["sample_values"] = lambda spark, sf: profiles.sample_values(
    table(spark, sf, "orders").drop("o_totalprice"), order_by=["o_orderkey"]
).select("name", F.array_join("samples", "|").alias("samples"))
ORACLES["sample_values"] = """
WITH f AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders ORDER BY o_orderkey LIMIT %d),
u AS (""" % profiles.SAMPLE_ROWS + " UNION ALL ".join(
    f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS v, i FROM f"
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
) + """), d AS (SELECT name, v, min(i) AS i FROM u WHERE v IS NOT NULL GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY i) AS k FROM d)
SELECT name, string_agg(v, '|' ORDER BY k) AS samples FROM n WHERE k <= %d GROUP BY name
""" % profiles.SAMPLE_VALUES


# Overrides and configs of the catalog, one decision per customer.
def _overrides(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.cast("string").alias("dataset"), choose(list(ORDERS), k).alias("name"),
        F.when(k % 3 == 0, "user").otherwise("ai").alias("source"),
        F.when(k % 5 != 4, choose(["categorical", "free_text", "datetime", "nonsense"], k)).alias("category"),
        F.when(k % 7 != 0, F.col("c_nationkey") * 4.0).alias("confidence"),
        F.concat(F.lit("why "), k).alias("rationale"),
        F.when(k % 2 == 0, F.col("c_name")).alias("alias"),
    )


def apply_overrides(spark, sf):
    """Columns with a user's choice have a suggestion too, which loses."""
    chosen = _overrides(spark, sf)
    beaten = chosen.filter("source = 'user' AND (category IS NULL OR category <> 'nonsense')").withColumns(
        {"source": F.lit("ai"), "category": F.lit("free_text"), "confidence": F.lit(99.0), "rationale": F.lit("late")})
    changed = overrides.apply_overrides(_catalog(spark, sf), chosen.unionByName(beaten))
    return changed.select("dataset", "name", "alias", "category", "category_source", "confidence", "needs_review", "rationale")


_OVERRIDES_SQL = f"""
SELECT CAST(c_custkey AS VARCHAR) AS dataset, {sql_choose([f"'{c}'" for c in ORDERS], 'c_custkey')} AS name,
       CASE WHEN c_custkey % 3 = 0 THEN 'user' ELSE 'ai' END AS source,
       CASE WHEN c_custkey % 5 <> 4 THEN ['categorical', 'free_text', 'datetime', 'nonsense'][c_custkey % 4 + 1] END AS category,
       CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_nationkey * 4 AS DOUBLE) END AS confidence, 'why ' || c_custkey AS rationale,
       CASE WHEN c_custkey % 2 = 0 THEN c_name END AS alias
FROM customer
"""
_OVERRIDDEN_SQL = f"""
SELECT p.dataset, p.name, CASE WHEN o.source = 'user' AND o.alias IS NOT NULL THEN o.alias ELSE p.alias END AS alias,
       CASE WHEN o.category IS NOT NULL THEN o.category ELSE p.category END AS category,
       CASE WHEN o.category IS NOT NULL THEN o.source ELSE 'rule' END AS category_source,
       CASE WHEN o.category IS NULL THEN p.confidence WHEN o.source = 'user' THEN 100.0 ELSE o.confidence END AS confidence,
       CASE WHEN o.category IS NULL THEN p.needs_review WHEN o.source = 'user' THEN false ELSE o.confidence < 70 END AS needs_review,
       CASE WHEN o.category IS NOT NULL AND o.source = 'ai' THEN o.rationale END AS rationale
FROM ({_CATALOG_SQL}) p LEFT JOIN (
    SELECT * FROM ({_OVERRIDES_SQL}) WHERE (source = 'user' OR confidence IS NOT NULL) AND
      (category IN ('categorical', 'free_text', 'datetime') OR (category IS NULL AND source = 'user'))) o
  ON o.dataset = p.dataset AND o.name = p.name
"""
QUERIES["apply_overrides"] = apply_overrides
ORACLES["apply_overrides"] = _OVERRIDDEN_SQL


def review_queue(spark, sf):
    changed = overrides.apply_overrides(_catalog(spark, sf), _overrides(spark, sf))
    return overrides.review_queue(changed).select("dataset", "name", "category", "confidence")


QUERIES["review_queue"] = review_queue
ORACLES["review_queue"] = f"""
SELECT dataset, name, category, confidence FROM ({_OVERRIDDEN_SQL}) WHERE needs_review AND category_source <> 'user'
"""


def overlay_configs(spark, sf):
    """Customers in credit saved a tag config, those outside building a range config."""
    key, name = F.col("c_custkey").cast("string").alias("dataset"), F.lit("o_orderpriority").alias("name")
    customers, segment = table(spark, sf, "customer"), F.col("c_mktsegment")
    tags = customers.filter("c_acctbal >= 0").select(key, name, F.when(segment == "MACHINERY", "-").alias("tag_separator"))
    spans = customers.filter(segment != "BUILDING").select(
        key, name, F.when(segment == "FURNITURE", "").otherwise("~").alias("separator"),
        F.when(segment != "HOUSEHOLD", "kg").alias("unit"))
    laid = overrides.overlay_configs(_catalog(spark, sf), tags, spans)
    return laid.select("dataset", "name", "multi_value_separator", "range_separator", "range_unit")


QUERIES["overlay_configs"] = overlay_configs
ORACLES["overlay_configs"] = """
WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders),
n AS (SELECT unnest(['o_orderkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS name)
SELECT CAST(k AS VARCHAR) AS dataset, name,
       CASE WHEN c_acctbal >= 0 THEN CASE c_mktsegment WHEN 'MACHINERY' THEN '-' ELSE ',' END END AS multi_value_separator,
       CASE WHEN c_mktsegment <> 'BUILDING' THEN CASE c_mktsegment WHEN 'FURNITURE' THEN '-' ELSE '~' END END AS range_separator,
       CASE WHEN c_mktsegment NOT IN ('BUILDING', 'HOUSEHOLD') THEN 'kg' END AS range_unit
FROM o CROSS JOIN n LEFT JOIN customer ON c_custkey = k AND name = 'o_orderpriority'
"""


def recommend_charts(spark, sf):
    lineitem = table(spark, sf, "lineitem")
    shapes = report.numeric_shape(lineitem)
    return report.recommend_charts(profiles.profile(lineitem), shapes).drop("dataset", "position")


_SHAPE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS name, (avg(pow({c}, 3)) - 3 * avg({c}) * avg(pow({c}, 2)) + 2 * pow(avg({c}), 3)) / pow(stddev_pop({c}), 3) "
    f"AS skew, min({c}) AS lo, max({c}) AS hi FROM lineitem"
    for c, t in LINEITEM.items() if t in ("int", "bigint", "double")
) + """ UNION ALL SELECT 'l_shipdate', NULL, date_diff('day', DATE '1970-01-01', CAST(min(l_shipdate) AS DATE)),
    date_diff('day', DATE '1970-01-01', CAST(max(l_shipdate) AS DATE)) FROM lineitem"""
_CHARTABLE = """category <> 'free_text' AND null_count < row_count
  AND NOT (category = 'categorical' AND distinct_count > 6 AND distinct_count > (row_count - null_count) * 0.5)"""
QUERIES["recommend_charts"] = recommend_charts
ORACLES["recommend_charts"] = f"""
SELECT p.name AS "column",
       CASE category WHEN 'datetime' THEN 'datetime' WHEN 'continuous_numerical' THEN 'numerical_bins' ELSE 'categorical' END
           AS partition_type,
       CASE WHEN category = 'datetime' THEN 'line'
            WHEN category = 'continuous_numerical' THEN
                 CASE WHEN abs(skew) < 1 AND NOT (lo >= 0 AND lo <= hi * 0.05) THEN 'bell_curve' ELSE 'histogram' END
            WHEN distinct_count <= 6 THEN 'pie' ELSE 'bar' END AS chart_type,
       alias || CASE WHEN category = 'datetime' THEN ' over time' ELSE ' distribution' END AS title,
       CASE WHEN category = 'datetime' THEN CASE WHEN hi - lo <= 62 THEN 'day' WHEN hi - lo <= 366 THEN 'week'
            WHEN hi - lo <= 3660 THEN 'month' ELSE 'year' END END AS grain
FROM ({profile_sql(counts_sql(LINEITEM, 'lineitem'), _aliases(LINEITEM))}) p LEFT JOIN ({_SHAPE_SQL}) s ON s.name = p.name
WHERE {_CHARTABLE}
"""


def recommend_grain(spark, sf):
    """The grain of every date column that the range of its dates asks for: of the events, and of the first of them."""
    events = table(spark, sf, "events")
    first = events.filter(F.col("ts") < events.agg(F.min("ts") + F.expr("INTERVAL 3 DAYS")).scalar())
    found = []
    for name, df in (("all", events), ("first", first), ("orders", table(spark, sf, "orders"))):
        charts = report.recommend_charts(profiles.profile(df, name), report.numeric_shape(df, name))
        found.append(charts.filter("partition_type = 'datetime'").select("dataset", "column", "grain"))
    return found[0].unionByName(found[1]).unionByName(found[2])


QUERIES["recommend_grain"] = recommend_grain
ORACLES["recommend_grain"] = """
WITH t AS (SELECT 'all' AS dataset, 'ts' AS "column", ts FROM events
  UNION ALL SELECT 'first', 'ts', ts FROM events WHERE ts < (SELECT min(ts) + INTERVAL 3 DAYS FROM events)
  UNION ALL SELECT 'orders', 'o_orderdate', o_orderdate FROM orders),
d AS (SELECT dataset, "column", date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS n FROM t GROUP BY ALL)
SELECT dataset, "column", CASE WHEN n <= 62 THEN 'day' WHEN n <= 366 THEN 'week' WHEN n <= 3660 THEN 'month' ELSE 'year' END AS grain
FROM d
"""


def chart_priority(spark, sf):
    """The catalog's recommendations in priority order, numbered."""
    ordered = chart_plans.prioritized(report.recommend_charts(_catalog(spark, sf)))
    rank = chart_plans.priority(F.col("partition_type")).alias("priority")
    return ordered.select("dataset", "column", "partition_type", "chart_type", rank)


QUERIES["chart_priority"] = chart_priority
ORACLES["chart_priority"] = f"""
SELECT dataset, name AS "column",
       CASE category WHEN 'datetime' THEN 'datetime' WHEN 'continuous_numerical' THEN 'numerical_bins' ELSE 'categorical' END
           AS partition_type,
       CASE WHEN category = 'datetime' THEN 'line' WHEN category = 'continuous_numerical' THEN 'histogram'
            WHEN distinct_count <= 6 THEN 'pie' ELSE 'bar' END AS chart_type,
       CAST(CASE category WHEN 'datetime' THEN 0 WHEN 'continuous_numerical' THEN 1 ELSE 2 END AS INTEGER) AS priority
FROM ({_CATALOG_SQL}) WHERE {_CHARTABLE}
"""


def validate_recommendations(spark, sf):
    """Proposals per order: every kind of defect turns up."""
    k = F.col("o_orderkey")
    proposed = table(spark, sf, "orders").select(
        k.alias("id"), F.col("o_custkey").cast("string").alias("dataset"),
        choose([*ORDERS, "no_such_column"], k).alias("column"),
        choose(["datetime", "numerical_bins", "categorical", "geo"], k).alias("partition_type"),
        choose(["line", "bar", "pie", "histogram", "bell_curve", "radar"], F.floor(k / 4)).alias("chart_type"),
        choose(["A title", "  ", "Another"], F.floor(k / 2)).alias("title"), choose(["SELECT 1", "", "SELECT 2"], F.floor(k / 5)).alias("sql"),
    )
    return chart_plans.validate_recommendations(proposed, _catalog(spark, sf))


QUERIES["validate_recommendations"] = validate_recommendations
ORACLES["validate_recommendations"] = f"""
WITH r AS (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS dataset,
      {sql_choose([f"'{c}'" for c in [*ORDERS, 'no_such_column']], 'o_orderkey')} AS "column",
      {sql_choose(["'datetime'", "'numerical_bins'", "'categorical'", "'geo'"], 'o_orderkey')} AS partition_type,
      {sql_choose(["'line'", "'bar'", "'pie'", "'histogram'", "'bell_curve'", "'radar'"], 'o_orderkey // 4')} AS chart_type,
      {sql_choose(["'A title'", "'  '", "'Another'"], 'o_orderkey // 2')} AS title,
      {sql_choose(["'SELECT 1'", "''", "'SELECT 2'"], 'o_orderkey // 5')} AS "sql" FROM orders)
SELECT * FROM r WHERE "column" <> 'no_such_column' AND partition_type <> 'geo' AND chart_type <> 'radar'
  AND trim(title) <> '' AND trim("sql") <> ''
"""


def auto_report(spark, sf):
    """Profile, recommendations and all count charts of the orders table, in long form."""
    orders = table(spark, sf, "orders")
    specs = report.chart_specs(report.recommend_charts(profiles.profile(orders)))
    return report.report_counts(orders, specs)


def auto_report_mixed(spark, sf):
    """A count, a measure, tags, a range and a chart that fails over the data: rows per chart, and whether it failed."""
    part = table(spark, sf, "part").withColumn("span", F.concat("p_size", F.lit("-"), F.col("p_size") + 10))
    specs = [
        chart_plans.ChartSpec("p_brand", "categorical", "bar", id="counts"),
        chart_plans.ChartSpec("p_brand", "categorical", "bar", id="measure", measure="p_retailprice", agg="avg"),
        chart_plans.ChartSpec("p_name", "categorical", "bar", id="tags", tags=TagConfig(tag_separator=" ")),
        chart_plans.ChartSpec("span", "numerical_bins", "histogram", id="range", range=RangeConfig()),
        chart_plans.ChartSpec("p_brand", "categorical", "bar", id="failing", measure="p_name", agg="avg"),
    ]
    made = report.auto_report(part, specs)
    failed = [(k, 0, True) for k, v in made.items() if isinstance(v, Exception)]
    out = spark.createDataFrame(failed, "chart string, rows bigint, failed boolean")
    for chart, df in made.items():
        if not isinstance(df, Exception):
            out = out.unionByName(df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(chart).alias("chart"), "rows", F.lit(False).alias("failed")))
    return out


QUERIES["auto_report_mixed"] = auto_report_mixed
ORACLES["auto_report_mixed"] = """
WITH s AS (SELECT p_size + 5.0 AS v FROM part), b AS (SELECT min(v) AS lo, max(v) AS hi FROM s)
SELECT 'counts' AS chart, count(DISTINCT p_brand) AS rows, false AS failed FROM part
UNION ALL SELECT 'measure', count(DISTINCT p_brand), false FROM part
UNION ALL SELECT 'tags', count(DISTINCT t), false FROM (SELECT trim(unnest(string_split(p_name, ' '))) AS t FROM part) WHERE t <> ''
UNION ALL SELECT 'range', count(DISTINCT least(floor((v - lo) / (hi - lo) * 10), 9)), false FROM s, b
UNION ALL SELECT 'failing', 0, true
"""


QUERIES["auto_report"] = auto_report
ORACLES["auto_report"] = " UNION ALL ".join(
    f"""SELECT 'numerical_bins:{c}' AS chart_id,
    CAST(CAST(CASE WHEN {c} = hi THEN 9 ELSE floor((CAST({c} AS DOUBLE) - lo) / (hi - lo) * 10) END AS INTEGER) AS VARCHAR) AS key,
    count(*) AS count FROM orders, (SELECT min({c}) AS lo, max({c}) AS hi FROM orders) GROUP BY ALL"""
    for c in ("o_orderkey", "o_custkey", "o_totalprice")
) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT 'categorical:{c}', {c}, count(*) FROM orders GROUP BY ALL" for c in ("o_orderstatus", "o_orderpriority")
) + """ UNION ALL SELECT 'datetime:o_orderdate', strftime(date_trunc('month', o_orderdate), '%Y-%m-%d'), count(*)
FROM orders GROUP BY ALL"""


def profile_appended(spark, sf):
    """Line items that arrive in four parts, their states stored one by one: the profile by return flag, and whether each
    distinct count is within the sketch's error bound of the exact one."""
    items, path = table(spark, sf, "lineitem"), scratch(spark)
    for part in range(4):
        sketches.append_states(items.filter(F.col("l_orderkey") % 4 == part), path, by="l_returnflag")
    found = sketches.estimated_profile(spark.read.parquet(path)).select("dataset", "name", "type", "row_count", "null_count", "distinct_count")
    exact = profiles.column_counts(items, by="l_returnflag").select("dataset", "name", F.col("distinct_count").alias("n"))
    near = F.abs(F.col("distinct_count") - F.col("n")) <= F.col("n") * sketches.ERROR_BOUND
    return found.join(exact, ["dataset", "name"]).select("dataset", "name", "type", "row_count", "null_count", F.col("n").alias("exact_count"), near.alias("within_bound"))


QUERIES["profile_appended"] = profile_appended
ORACLES["profile_appended"] = " UNION ALL ".join(
    f"""SELECT l_returnflag AS dataset, '{c}' AS name, '{t}' AS type, count(*) AS row_count, count(*) - count({c}) AS null_count,
    count(DISTINCT {c}) AS exact_count, true AS within_bound FROM lineitem GROUP BY 1"""
    for c, t in LINEITEM.items() if c != "l_returnflag")
