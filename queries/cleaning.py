"""Cleaning, type inference, ingest, stored datasets, deduplication and ad-hoc SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from queries.common import choose, scratch, sql_choose, table
from queries.profiles import tenths
from tabsmith.functions.text import NULL_TOKENS
from tabsmith.operators import cleaning
from tabsmith.operators.edits import EditRules, Merge, apply_edits
from tabsmith.plans.ingest import ingest_csv
from tabsmith.plans.query import UnsafeQueryError, query, run_query
from tabsmith.sources import files, known
from tabsmith.sources.csv import MalformedCsvError, assert_csv_clean, read_csv_clean, read_csv_text
from tabsmith.sources.dataset import open_dataset, preview, write_dataset

QUERIES, ORACLES = {}, {}


def nullify_sentinels(spark, sf):
    k = F.col("o_orderkey")
    status = choose([*NULL_TOKENS, F.col("o_orderstatus"), "na"], k).alias("status")
    return cleaning.nullify_sentinels(table(spark, sf, "orders").select(k, status))


QUERIES["nullify_sentinels"] = nullify_sentinels
ORACLES["nullify_sentinels"] = """
SELECT o_orderkey, CASE o_orderkey % 16 WHEN 14 THEN o_orderstatus WHEN 15 THEN 'na' END AS status FROM orders
"""

_TEXTS = {
    "number": "CAST(p_partkey AS STRING)",
    "price": "CAST(p_retailprice AS STRING)",
    "padded": "lpad(CAST(p_size AS STRING), 5, '0')",
    "flag": "CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'F' END",
    "day": "concat('2024-', p_partkey % 12 + 1, '-', p_size % 28 + 1)",
    "moment": "concat('2024-01-', p_size % 28 + 1, ' 10:', lpad(CAST(p_partkey % 60 AS STRING), 2, '0'))",
    "partial_day": "concat('2024-', p_partkey % 12 + 1)",
    "suffixed": "concat(p_size, 'd')",
    "big": "concat('1', lpad(CAST(p_partkey AS STRING), 20, '0'))",
    "one_bad": "CASE WHEN p_partkey = 7 THEN 'x' ELSE CAST(p_size AS STRING) END",
}
_TYPES = {
    "number": "bigint", "price": "double", "padded": "string", "flag": "boolean", "day": "date", "moment": "timestamp_ntz",
    "partial_day": "string", "suffixed": "string", "big": "decimal(38,0)", "one_bad": "string",
}


def infer_types(spark, sf):
    typed = cleaning.infer_types(table(spark, sf, "part").selectExpr(*[f"{e} AS {n}" for n, e in _TEXTS.items()]))
    rows = [F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"),
                     F.count(f.name).alias("values"), F.min(f.name).cast("string").alias("least"),
                     F.max(f.name).cast("string").alias("most")) for f in typed.schema]
    return typed.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


QUERIES["infer_types"] = infer_types
ORACLES["infer_types"] = " UNION ALL ".join(
    f"SELECT '{n}' AS name, '{t}' AS type, count(x) AS values, CAST(min(x) AS STRING) AS least, CAST(max(x) AS STRING) AS most FROM "
    f"(SELECT {'CAST(' + e + ' AS ' + {'bigint': 'BIGINT', 'double': 'DOUBLE', 'boolean': 'BOOLEAN', 'date': 'DATE', 'timestamp_ntz': 'TIMESTAMP'}[t] + ')' if t in ('bigint', 'double', 'boolean', 'date', 'timestamp_ntz') else e} AS x FROM part)"
    for (n, e), t in zip(_TEXTS.items(), _TYPES.values())
).replace("STRING", "VARCHAR")

# Dates in five formats and one in six junk; money in four spellings and one in ten junk.
_DATE_KEY = "o_orderkey % 6"


def _messy(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    texts = [F.date_format(d, p) for p in ("yyyy-MM-dd", "MM/dd/yyyy", "MMMM d, yyyy", "yyyy/M/d", "yyyy-MM-dd HH:mm:ss")]
    amount = F.format_number("o_totalprice", 2)
    money = F.when(k % 10 == 9, "ask").otherwise(choose(
        [F.concat(F.lit("$"), amount), amount, F.concat(F.lit(" -$ "), F.round("o_totalprice", 0).cast("bigint")), F.concat(F.col("o_totalprice").cast("string"), F.lit(" %"))], k))
    return table(spark, sf, "orders").select(
        k, choose([*texts, "5-Apr-2024"], k).alias("day"), money.alias("amount"), "o_orderpriority")


_MESSY_SQL = f"""
SELECT o_orderkey, {sql_choose(["strftime(o_orderdate, '%Y-%m-%d')", "strftime(o_orderdate, '%m/%d/%Y')",
    "strftime(o_orderdate, '%B %-d, %Y')", "strftime(o_orderdate, '%Y/%-m/%-d')", "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')",
    "'5-Apr-2024'"], 'o_orderkey')} AS day,
  CASE WHEN o_orderkey % 10 = 9 THEN 'ask' ELSE {sql_choose(["'$' || format('{:,.2f}', o_totalprice)", "format('{:,.2f}', o_totalprice)",
    "' -$ ' || CAST(round(o_totalprice) AS BIGINT)", "CAST(o_totalprice AS VARCHAR) || ' %'"], 'o_orderkey')} END AS amount,
  o_orderpriority
FROM orders
"""
_DAY_SQL = "coalesce(" + ", ".join(
    f"try_strptime(day, '{f}')" for f in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%B %d, %Y")) + ")::DATE"
_AMOUNT_SQL = "TRY_CAST(trim(translate(amount, '$,%', '')) AS DOUBLE)"

QUERIES["normalize_dates"] = lambda spark, sf: cleaning.normalize_dates(_messy(spark, sf)).select("o_orderkey", "day")
ORACLES["normalize_dates"] = f"SELECT o_orderkey, {_DAY_SQL} AS day FROM ({_MESSY_SQL})"

QUERIES["normalize_money"] = lambda spark, sf: cleaning.normalize_numeric_strings(_messy(spark, sf)).select("o_orderkey", "amount")
ORACLES["normalize_money"] = f"SELECT o_orderkey, {_AMOUNT_SQL} AS amount FROM ({_MESSY_SQL})"


def conversion_losses(spark, sf):
    parsed = {"day": cleaning.parse_date(F.col("day")), "amount": cleaning.parse_numeric_string(F.col("amount"))}
    lost = cleaning.conversion_losses(_messy(spark, sf), parsed)
    dates = cleaning.conversion_warning(F.col("newly_null"), F.col("non_null_before"))
    money = cleaning.conversion_warning(F.col("newly_null"), F.col("non_null_before"), cleaning.MONEY_WARNING)
    return lost.withColumn("warning", F.when(F.col("name") == "day", dates).otherwise(money))


QUERIES["conversion_losses"] = conversion_losses
ORACLES["conversion_losses"] = f"""
WITH m AS ({_MESSY_SQL}),
l AS (SELECT 'day' AS name, count(day) AS n, count(day) - count({_DAY_SQL}) AS k FROM m UNION ALL
      SELECT 'amount', count(amount), count(amount) - count({_AMOUNT_SQL}) FROM m)
SELECT name, n AS non_null_before, k AS newly_null, k || ' of ' || n || CASE name
    WHEN 'day' THEN ' non-null values did not match a recognized date format and were set to NULL.'
    ELSE ' non-null values were not recognized as numbers (after stripping $/,/%) and were set to NULL.' END AS warning
FROM l
"""


def detect_columns(spark, sf):
    """Shares behind the two detectors, and their verdicts."""
    messy = _messy(spark, sf)
    found = cleaning.text_facts(messy)
    rows = [(n, f.values, f.dates, f.money_shaped, f.is_date, f.is_money and not f.is_date) for n, f in found.items()]
    return spark.createDataFrame(
        rows, "name string, values bigint, dates bigint, money_shaped bigint, is_date boolean, is_money boolean")


_MONEY_PATTERN = r"^\s*-?\$?\s?(\d{1,3}(,\d{3})*|\d+)(\.\d+)?\s?%?\s*$"
QUERIES["detect_columns"] = detect_columns
ORACLES["detect_columns"] = f"""
WITH m AS ({_MESSY_SQL}),
u AS (SELECT 'day' AS name, day AS v FROM m UNION ALL SELECT 'amount', amount FROM m UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM m),
c AS (SELECT name, count(v) AS values, count({_DAY_SQL.replace('day', 'v')}) AS dates,
             count(CASE WHEN regexp_matches(v, '{_MONEY_PATTERN}') THEN 1 END) AS money_shaped FROM u GROUP BY name)
SELECT *, dates / values >= 0.8 AS is_date, money_shaped / values >= 0.8 AND dates / values < 0.8 AS is_money FROM c
"""


def _as_csv(spark, df):
    path = scratch(spark)
    df.write.option("header", True).option("escape", '"').csv(path)
    return path


def csv_ingest(spark, sf):
    """The messy orders as CSV text and back through the clean reader."""
    k = F.col("o_orderkey")
    messy = _messy(spark, sf).select("*", F.when(k % 4 == 0, "N/A").otherwise((k % 4).cast("string")).alias("grade"),
                                     F.concat(F.lit('a "quoted", '), k).alias("note"))
    return read_csv_clean(spark, _as_csv(spark, messy))


QUERIES["csv_ingest"] = csv_ingest
ORACLES["csv_ingest"] = f"""
SELECT o_orderkey, {_DAY_SQL} AS day, {_AMOUNT_SQL} AS amount, o_orderpriority, nullif(o_orderkey % 4, 0) AS grade,
       'a "quoted", ' || o_orderkey AS note
FROM ({_MESSY_SQL})
"""


def ingest_profile(spark, sf):
    """CSV to stored dataset to profile, with its warnings."""
    done = ingest_csv(spark, _as_csv(spark, _messy(spark, sf)), scratch(spark))
    return done.profile.select("name", "type", "category", "row_count", "null_count", "distinct_count", "health_score",
                               "conversion_warning")


QUERIES["ingest_profile"] = ingest_profile
ORACLES["ingest_profile"] = f"""
WITH m AS (SELECT o_orderkey, {_DAY_SQL} AS day, {_AMOUNT_SQL} AS amount, o_orderpriority FROM ({_MESSY_SQL})),
p AS (SELECT 'o_orderkey' AS name, 'bigint' AS type, 'continuous_numerical' AS category, count(o_orderkey) AS k, count(DISTINCT o_orderkey) AS d FROM m
 UNION ALL SELECT 'day', 'date', 'datetime', count(day), count(DISTINCT day) FROM m
 UNION ALL SELECT 'amount', 'double', 'continuous_numerical', count(amount), count(DISTINCT amount) FROM m
 UNION ALL SELECT 'o_orderpriority', 'string', 'categorical', count(*), count(DISTINCT o_orderpriority) FROM m)
SELECT name, type, category, n AS row_count, n - k AS null_count, d AS distinct_count,
       {tenths('(1 - (n - k) / n) * 100')} AS health_score,
       CASE name WHEN 'day' THEN (n - k) || ' of ' || n || ' non-null values did not match a recognized date format and were set to NULL.'
                 WHEN 'amount' THEN (n - k) || ' of ' || n || ' non-null values were not recognized as numbers (after stripping $/,/%) and were set to NULL.'
       END AS conversion_warning
FROM p, (SELECT count(*) AS n FROM orders)
"""


def stored_dataset(spark, sf):
    """Written once, opened with an edit: the edited column reads as text, the rest keep their types."""
    path = write_dataset(table(spark, sf, "customer"), scratch(spark))
    return open_dataset(spark, path, EditRules().with_merge("c_nationkey", Merge("north", ["1", "2", "3"])))


QUERIES["stored_dataset"] = stored_dataset
ORACLES["stored_dataset"] = """
SELECT c_custkey, c_name, CASE WHEN c_nationkey IN (1, 2, 3) THEN 'north' ELSE CAST(c_nationkey AS VARCHAR) END AS c_nationkey,
       c_acctbal, c_mktsegment
FROM customer
"""

QUERIES["preview"] = lambda spark, sf: preview(table(spark, sf, "orders"), order_by=["o_orderkey"])
ORACLES["preview"] = "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20"


def adhoc_sql(spark, sf):
    edited = EditRules().with_merge("o_orderpriority", Merge("SOON", ["1-URGENT", "2-HIGH"]))
    return query(apply_edits(table(spark, sf, "orders"), edited), """
        WITH big AS (SELECT "o_orderpriority" AS p, o_totalprice AS x FROM data WHERE o_totalprice > 100000)
        SELECT p, count(*) AS n, round(max(x), 2) AS top FROM big GROUP BY p -- post-edit values
    """)


QUERIES["adhoc_sql"] = adhoc_sql
ORACLES["adhoc_sql"] = """
SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'SOON' ELSE o_orderpriority END AS p, count(*) AS n,
       round(max(o_totalprice), 2) AS top
FROM orders WHERE o_totalprice > 100000 GROUP BY 1
"""


def dedup_documents(spark, sf):
    return files.dedup_rows(table(spark, sf, "documents"), "text", ["doc_id"]).select("doc_id", "source", "n_chars")


QUERIES["dedup_documents"] = dedup_documents
ORACLES["dedup_documents"] = """
SELECT doc_id, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1
"""


def _registry(spark, sf):
    """A registry of the documents: the source owns them, the text is the content."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("path"), F.col("lang").alias("owner"), F.md5("text").alias("content_hash"),
        F.make_timestamp_ntz(F.lit(2024), F.lit(1), (F.col("doc_id") % 28 + 1).cast("int"), F.lit(0), F.lit(0), F.lit(0)).alias("created_at"),
    )


_REGISTRY_SQL = """
SELECT CAST(doc_id AS VARCHAR) AS path, lang AS owner, md5(text) AS content_hash,
       make_timestamp(2024, 1, doc_id % 28 + 1, 0, 0, 0) AS created_at
FROM documents
"""
_STORED_SQL = f"""
SELECT *, first_value(path) OVER (PARTITION BY owner, content_hash ORDER BY created_at, path) AS stored_path FROM ({_REGISTRY_SQL})
"""
QUERIES["dedup_registry"] = lambda spark, sf: files.dedup_registry(_registry(spark, sf))
ORACLES["dedup_registry"] = f"SELECT *, path <> stored_path AS is_copy FROM ({_STORED_SQL})"


def storage_refcount(spark, sf):
    stored = files.dedup_registry(_registry(spark, sf))
    registry = stored.select(F.col("path").alias("dataset"), F.concat(F.lit("raw/"), "stored_path").alias("raw_key"))
    return files.storage_refcount(registry)


QUERIES["storage_refcount"] = storage_refcount
ORACLES["storage_refcount"] = f"""
SELECT path AS dataset, 'raw/' || stored_path AS raw_key, count(*) OVER (PARTITION BY stored_path) - 1 AS other_references
FROM ({_STORED_SQL})
"""


def list_datasets(spark, sf):
    registry = _registry(spark, sf).withColumnRenamed("path", "dataset")
    return files.list_datasets(registry, "en").select("dataset", "created_at")


QUERIES["list_datasets"] = list_datasets
ORACLES["list_datasets"] = f"SELECT path AS dataset, created_at FROM ({_REGISTRY_SQL}) WHERE owner = 'en'"


def dedup_files(spark, sf):
    """Fifty pages are a file, written twice, and a third time with an end of its own: of three, two stay."""
    group = F.floor(F.col("page_id") / 50)
    rows, base = table(spark, sf, "pages").select(group.alias("pages"), "page_id", F.coalesce("html", F.lit("")).alias("value")), scratch(spark)
    last = rows.groupBy("pages").agg((F.max("page_id") + 1).alias("page_id"), F.lit("end").alias("value"))
    for copy, found in (("first", rows), ("second", rows), ("third", rows.unionByName(last.select(*rows.columns)))):
        found.repartition("pages").sortWithinPartitions("pages", "page_id").drop("page_id").write.partitionBy("pages").text(f"{base}/{copy}")
    found = files.dedup_files(spark, base, "me").filter(F.col("path").endswith(".txt"))
    pages = F.regexp_extract("path", r"pages=(\d+)", 1).cast("long").alias("pages")
    return found.groupBy(pages).agg(
        F.count(F.lit(1)).alias("files"), F.count_if("is_copy").alias("copies"), F.count_distinct("stored_path").alias("stored"))


QUERIES["dedup_files"] = dedup_files
ORACLES["dedup_files"] = "SELECT DISTINCT CAST(page_id // 50 AS BIGINT) AS pages, 3 AS files, 1 AS copies, 2 AS stored FROM pages"


def dedup_arrivals(spark, sf):
    """Documents arrive in five batches by doc_id; each meets the digests of all batches before it."""
    docs, root = table(spark, sf, "documents").select("doc_id", "text"), scratch(spark)
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    out = None
    for k in range(5):
        ends = [low + (high + 1 - low) * e // 5 for e in (k, k + 1)]
        arrived = docs.filter((F.col("doc_id") >= ends[0]) & (F.col("doc_id") < ends[1]))
        found = known.register(arrived, root, k, "text", "doc_id").select("doc_id", "first_key", "is_copy")
        out = found if out is None else out.unionByName(found)
    return out


QUERIES["dedup_arrivals"] = dedup_arrivals
ORACLES["dedup_arrivals"] = """
SELECT doc_id, min(doc_id) OVER same AS first_key, doc_id <> min(doc_id) OVER same AS is_copy
FROM documents WINDOW same AS (PARTITION BY md5(coalesce(text, '')))
"""


def write_lines(lines, header, path):
    """Lines of text as CSV files that all begin with the header; their number grows with the table."""
    raw = {"header": True, "sep": "\x01", "quote": "", "escapeQuotes": False, "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    lines.repartition(2 + lines.count() // 5000, "at").sortWithinPartitions("at").select(F.col("value").alias(header)).write.options(**raw).csv(path)


def csv_ragged_rows(spark, sf):
    """Orders as CSV lines, every seventh with a field too many: what the reader finds off, and that it rejects the files."""
    k, path = F.col("o_orderkey"), scratch(spark)
    line = F.concat_ws(",", k, "o_orderstatus", F.when(k % 7 == 0, "more")).alias("value")
    write_lines(table(spark, sf, "orders").select(line, k.alias("at")), "o_orderkey,o_orderstatus", path)
    df = read_csv_text(spark, path)
    try:
        assert_csv_clean(df)
        rejected = False
    except MalformedCsvError:
        rejected = True
    counts = df.agg(F.count(F.lit(1)).alias("rows"), F.count("_corrupt_record").alias("ragged"), F.count("o_orderkey").alias("keys"))
    return counts.withColumn("rejected", F.lit(rejected))


QUERIES["csv_ragged_rows"] = csv_ragged_rows
ORACLES["csv_ragged_rows"] = """
SELECT count(*) AS rows, count(*) FILTER (o_orderkey % 7 = 0) AS ragged, count(*) AS keys, count(*) FILTER (o_orderkey % 7 = 0) > 0 AS rejected
FROM orders
"""


def csv_duplicate_names(spark, sf):
    """A header that names columns twice, in another case too."""
    path = scratch(spark)
    part = table(spark, sf, "part").select(F.concat_ws(",", "p_partkey", "p_size", "p_size", "p_partkey").alias("value"), F.col("p_partkey").alias("at"))
    write_lines(part, "key,size,Size,KEY", path)
    return read_csv_clean(spark, path)


QUERIES["csv_duplicate_names"] = csv_duplicate_names
ORACLES["csv_duplicate_names"] = 'SELECT p_partkey AS key, p_size::BIGINT AS size, p_size::BIGINT AS "Size_1", p_partkey AS "KEY_1" FROM part'


def adhoc_truncated(spark, sf):
    """Whether a query over the orders had more rows than it may hand back."""
    rows = [(n, len(found), more) for n in (10, 1_000_000) for _, found, more in (
        run_query(table(spark, sf, "orders"), "SELECT o_orderstatus, o_orderpriority, count(*) FROM data GROUP BY ALL", n),)]
    return spark.createDataFrame(rows, "most bigint, rows bigint, truncated boolean")


QUERIES["adhoc_truncated"] = adhoc_truncated
ORACLES["adhoc_truncated"] = """
WITH g AS (SELECT count(*) AS n FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders))
SELECT most, least(n, most) AS rows, n > most AS truncated FROM g, (SELECT unnest([10, 1000000]) AS most)
"""


# Texts that a user may send, and whether they are a safe query.
TEXTS = [
    ("count", "SELECT count(*) AS value FROM data WHERE o_orderstatus = 'F'"),
    ("with", "WITH t AS (SELECT o_custkey, max(o_totalprice) AS m FROM data GROUP BY 1) SELECT count(*) AS value FROM t WHERE m > 200000;"),
    ("word in a text", "SELECT count(*) AS value FROM data WHERE o_orderpriority <> 'reflect'"),
    ("word as a column", "SELECT count(DISTINCT reflect) AS value FROM (SELECT o_custkey AS reflect FROM data)"),
    ("subquery", "SELECT count(*) AS value FROM data WHERE o_totalprice > (SELECT avg(o_totalprice) FROM data)"),
    ("window", "SELECT count(*) AS value FROM (SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM data) WHERE k = 2"),
    ("java", "SELECT count(java_method('java.lang.System', 'getProperty', 'user.home')) AS value FROM data"),
    ("java by a built name", "SELECT count(IDENTIFIER('java_' || 'method')('java.lang.System', 'getProperty', 'user.home')) AS value FROM data"),
    ("file name", "SELECT count(input_file_name()) AS value FROM data"),
    ("other view", "SELECT count(*) AS value FROM other"),
    ("file", "SELECT count(*) AS value FROM parquet.`/tmp/other.parquet`"),
    ("two statements", "SELECT 1 AS value; SELECT 2"),
    ("statement", "DROP TABLE data"),
]


def adhoc_guard(spark, sf):
    """For each text whether it may run over the orders, and if so what it gives."""
    orders = table(spark, sf, "orders")
    out = spark.createDataFrame([], "name string, accepted boolean, value bigint")
    for name, text in TEXTS:
        try:
            found = query(orders, text).select(F.lit(name).alias("name"), F.lit(True).alias("accepted"), F.col("value").cast("long").alias("value"))
        except UnsafeQueryError:
            found = spark.createDataFrame([(name, False, None)], out.schema)
        out = out.unionByName(found)
    return out


QUERIES["adhoc_guard"] = adhoc_guard
ORACLES["adhoc_guard"] = " UNION ALL ".join(
    f"SELECT '{name}' AS name, true AS accepted, CAST(value AS BIGINT) AS value FROM ({text.replace('FROM data', 'FROM orders').rstrip(';')})" for name, text in TEXTS[:6]
) + "".join(f" UNION ALL SELECT '{name}', false, NULL" for name, _ in TEXTS[6:])
