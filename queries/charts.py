"""Chart aggregations, filters, measures and what is derived from them."""
from __future__ import annotations

from pyspark.sql import functions as F

from queries.common import r6, scratch, table
from tabsmith.operators import charts, facts, inverse
from tabsmith.operators.charts import ChartFilter
from tabsmith.operators.edits import EditRules, Merge, Replacement
from tabsmith.operators.ranges import RangeConfig
from tabsmith.operators.tags import TagConfig
from tabsmith.plans.charts import ChartSpec, run_chart

QUERIES, ORACLES = {}, {}


def _series(name, grain, source, col):
    QUERIES[name] = lambda spark, sf: charts.time_series(table(spark, sf, source), col, grain)
    ORACLES[name] = (
        f"SELECT CAST(date_trunc('{grain}', {col}) AS TIMESTAMP) AS period, count(*) AS count "
        f"FROM {source} WHERE {col} IS NOT NULL GROUP BY ALL"
    )


_series("time_series_day", "day", "events", "ts")
_series("time_series_week", "week", "events", "ts")
_series("time_series_month", "month", "orders", "o_orderdate")
_series("time_series_year", "year", "lineitem", "l_shipdate")


def time_series_label(spark, sf):
    return charts.with_period_label(charts.time_series(table(spark, sf, "orders"), "o_orderdate", "week"))


QUERIES["time_series_label"] = time_series_label
ORACLES["time_series_label"] = """
SELECT period, count(*) AS count, strftime(period, '%Y-%m-%d') AS label
FROM (SELECT CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS period FROM orders) GROUP BY ALL
"""

QUERIES["category_counts"] = lambda spark, sf: charts.category_counts(table(spark, sf, "orders"), "o_orderpriority")
ORACLES["category_counts"] = "SELECT o_orderpriority AS category, count(*) AS count FROM orders GROUP BY ALL"

QUERIES["category_share"] = lambda spark, sf: charts.with_share(
    charts.category_counts(table(spark, sf, "customer"), "c_mktsegment")
)
ORACLES["category_share"] = """
SELECT c_mktsegment AS category, count(*) AS count,
       CAST(format('{:.1f}', count(*) / (SELECT count(*) FROM customer) * 100) AS DOUBLE) AS share
FROM customer GROUP BY ALL
"""


# Equal-width bins: one CTE with the bounds, one with the bin of every value.
def _hist_sql(col, source, bins, where="TRUE"):
    return f"""
WITH v AS (SELECT CAST({col} AS DOUBLE) AS x FROM {source} WHERE {col} IS NOT NULL AND {where}),
b AS (SELECT min(x) AS lo, max(x) AS hi, avg(x) AS m, stddev_samp(x) AS s FROM v),
k AS (SELECT CASE WHEN hi = lo OR x = hi THEN {bins - 1} ELSE CAST(floor((x - lo) / (hi - lo) * {bins}) AS INTEGER) END
             AS bucket FROM v, b)
SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS count, round(any_value(m), 6) AS mean,
       round(any_value(s), 6) AS stddev, any_value(lo) AS min_val, any_value(hi) AS max_val
FROM k, b GROUP BY bucket
"""


def _hist(name, source, col, bins):
    def run(spark, sf):
        h = charts.histogram(table(spark, sf, source), col, bins)
        return h.select("bucket", "count", r6("mean"), r6("stddev"), "min_val", "max_val")

    QUERIES[name] = run
    ORACLES[name] = _hist_sql(col, source, bins)


_hist("histogram", "lineitem", "l_quantity", 10)
_hist("histogram_20", "lineitem", "l_extendedprice", 20)
_hist("histogram_customer", "customer", "c_acctbal", 8)


def bell_curve(spark, sf):
    h = charts.bell_curve(charts.histogram(table(spark, sf, "customer"), "c_acctbal", 15), 15)
    return h.select("bucket", "count", r6("curve"))


QUERIES["bell_curve"] = bell_curve
ORACLES["bell_curve"] = f"""
WITH h AS ({_hist_sql('c_acctbal', 'customer', 15)}),
s AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS sd FROM customer)
SELECT bucket, count,
       round((SELECT max(count) FROM h) * exp(-0.5 * pow(
           (min_val + (bucket + 0.5) * (max_val - min_val) / 15 - m) / sd, 2)), 6) AS curve
FROM h, s
"""


def bin_edges(spark, sf):
    h = charts.with_bin_edges(charts.histogram(table(spark, sf, "orders"), "o_totalprice", 5), 5)
    return h.select("bucket", "count", r6("bin_start"), r6("bin_end"))


QUERIES["bin_edges"] = bin_edges
ORACLES["bin_edges"] = f"""
SELECT bucket, count, round(min_val + bucket * (max_val - min_val) / 5, 6) AS bin_start,
       round(min_val + (bucket + 1) * (max_val - min_val) / 5, 6) AS bin_end
FROM ({_hist_sql('o_totalprice', 'orders', 5)})
"""


def dense_bins(spark, sf):
    """Discounts take eleven values, so some of twenty bins are empty."""
    h = charts.dense_bins(charts.histogram(table(spark, sf, "lineitem"), "l_discount", 20), 20)
    # abs(): the data holds both 0.0 and -0.0.
    return h.select("bucket", "count", F.abs("min_val").alias("min_val"), "max_val")


QUERIES["dense_bins"] = dense_bins
ORACLES["dense_bins"] = f"""
WITH h AS ({_hist_sql('l_discount', 'lineitem', 20)})
SELECT CAST(i AS INTEGER) AS bucket, coalesce(h.count, 0) AS count,
       (SELECT abs(min(l_discount)) FROM lineitem) AS min_val, (SELECT max(l_discount) FROM lineitem) AS max_val
FROM range(20) r(i) LEFT JOIN h ON h.bucket = r.i
"""


def filter_equals(spark, sf):
    spec = ChartSpec("o_orderdate", "datetime", "line")
    return run_chart(table(spark, sf, "orders"), spec, ChartFilter("o_orderpriority", equals="1-URGENT"))


QUERIES["filter_equals"] = filter_equals
ORACLES["filter_equals"] = """
SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period, count(*) AS count
FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL
"""


def filter_range(spark, sf):
    spec = ChartSpec("l_returnflag", "categorical", "pie")
    return run_chart(table(spark, sf, "lineitem"), spec, ChartFilter("l_quantity", lo=10.0, hi=20.0))


QUERIES["filter_range"] = filter_range
ORACLES["filter_range"] = """
SELECT l_returnflag AS category, count(*) AS count FROM lineitem
WHERE l_quantity >= 10 AND l_quantity < 20 GROUP BY ALL
"""


def filter_last_bin(spark, sf):
    """The last of ten bins of quantity (1 to 50) takes in the maximum."""
    spec = ChartSpec("l_linestatus", "categorical", "pie")
    return run_chart(table(spark, sf, "lineitem"), spec, charts.bin_filter("l_quantity", 9, 10, 1.0, 50.0))


QUERIES["filter_last_bin"] = filter_last_bin
ORACLES["filter_last_bin"] = """
SELECT l_linestatus AS category, count(*) AS count FROM lineitem
WHERE l_quantity >= 1 + 9 * 4.9 AND l_quantity <= 50 GROUP BY ALL
"""


def filter_own_column(spark, sf):
    """A filter on the chart's own column changes nothing; the bin count does."""
    spec = ChartSpec("l_quantity", "numerical_bins", "histogram")
    h = run_chart(table(spark, sf, "lineitem"), spec, ChartFilter("l_quantity", lo=1.0, hi=5.0), bins=5)
    return h.select("bucket", "count")


QUERIES["filter_own_column"] = filter_own_column
ORACLES["filter_own_column"] = f"SELECT bucket, count FROM ({_hist_sql('l_quantity', 'lineitem', 5)})"


def filter_merged_value(spark, sf):
    """A filter on a merged value, turned into a list of stored ones."""
    rules = EditRules().with_merge("o_orderpriority", Merge("SOON", ["1-URGENT", "2-HIGH"]))
    spec = ChartSpec("o_orderstatus", "categorical", "pie")
    return run_chart(table(spark, sf, "orders"), spec, ChartFilter("o_orderpriority", equals="SOON"), edits=rules)


QUERIES["filter_merged_value"] = filter_merged_value
ORACLES["filter_merged_value"] = """
SELECT o_orderstatus AS category, count(*) AS count FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY ALL
"""


def filter_replaced_value(spark, sf):
    """A filter on a value that a regex replacement and a merge make, as a list of stored values in the scan."""
    orders = table(spark, sf, "orders")
    rules = EditRules().with_replacement("o_orderpriority", Replacement(r"^\d-(\w)\w*", r"\1", is_regex=True))
    rules = rules.with_merge("o_orderpriority", Merge("SOON", ["U", "H"]))
    path = inverse.write_dictionaries(orders, ["o_orderpriority"], scratch(spark))
    known = {"o_orderpriority": inverse.open_dictionary(spark, path, "o_orderpriority")}
    spec = ChartSpec("o_orderstatus", "categorical", "pie")
    return run_chart(orders, spec, ChartFilter("o_orderpriority", equals="SOON"), edits=rules, dictionaries=known)


QUERIES["filter_replaced_value"] = filter_replaced_value
ORACLES["filter_replaced_value"] = r"""
SELECT o_orderstatus AS category, count(*) AS count FROM orders
WHERE regexp_replace(o_orderpriority, '^\d-(\w)\w*', '\1', 'g') IN ('U', 'H', 'SOON') GROUP BY ALL
"""


def filter_replaced_numbers(spark, sf):
    """Prices that read as ending in 7 once the cents are cut: more stored numbers than a list takes."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    rules = EditRules().with_replacement("o_totalprice", Replacement(r"\.\d*$", "", is_regex=True))
    path = inverse.write_dictionaries(orders, ["o_totalprice"], scratch(spark))
    known = inverse.open_dictionary(spark, path, "o_totalprice")
    return inverse.filter_edited(orders, rules, "o_totalprice", lambda text: text.endswith("7"), known)


QUERIES["filter_replaced_numbers"] = filter_replaced_numbers
ORACLES["filter_replaced_numbers"] = r"""
SELECT o_orderkey, regexp_replace(CAST(o_totalprice AS VARCHAR), '\.\d*$', '') AS o_totalprice FROM orders
WHERE regexp_replace(CAST(o_totalprice AS VARCHAR), '\.\d*$', '') LIKE '%7'
"""


def filter_measure_chart(spark, sf):
    """A filter keeps a measure chart a measure chart."""
    spec = ChartSpec("o_orderstatus", "categorical", "pie", measure="o_totalprice", agg="avg")
    return run_chart(
        table(spark, sf, "orders"), spec, ChartFilter("o_orderpriority", equals="5-LOW")
    ).select("category", r6("value"))


QUERIES["filter_measure_chart"] = filter_measure_chart
ORACLES["filter_measure_chart"] = """
SELECT o_orderstatus AS category, round(avg(o_totalprice), 6) AS value
FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY ALL
"""


def filter_tag_chart(spark, sf):
    spec = ChartSpec("p_name", "categorical", "bar", tags=TagConfig(tag_separator=" "))
    return run_chart(table(spark, sf, "part"), spec, ChartFilter("p_type", equals="ECONOMY"))


QUERIES["filter_tag_chart"] = filter_tag_chart
ORACLES["filter_tag_chart"] = """
SELECT category, count(*) AS count
FROM (SELECT unnest(string_split(p_name, ' ')) AS category FROM part WHERE p_type = 'ECONOMY')
WHERE category <> '' GROUP BY ALL
"""


def filter_range_chart(spark, sf):
    parts = table(spark, sf, "part").withColumn("span", F.expr("concat(p_size, '-', p_size + 10, ' yrs')"))
    spec = ChartSpec("span", "numerical_bins", "histogram", bins=5, range=RangeConfig(unit="yrs"))
    return run_chart(parts, spec, ChartFilter("p_brand", equals="Brand#3"))


QUERIES["filter_range_chart"] = filter_range_chart
ORACLES["filter_range_chart"] = f"""
SELECT bucket, count, min_val, max_val FROM ({_hist_sql('(p_size + 5)', 'part', 5, "p_brand = 'Brand#3'")})
"""


def _measure(name, source, dim, measure, agg, **options):
    def run(spark, sf):
        out = charts.measure_by(table(spark, sf, source), dim, measure, agg, **options)
        return out.withColumn("value", F.round("value", 4)) if agg != "count" else out

    QUERIES[name] = run


_measure("measure_avg_by_category", "customer", "c_mktsegment", "c_acctbal", "avg")
ORACLES["measure_avg_by_category"] = (
    "SELECT c_mktsegment AS category, round(avg(c_acctbal), 4) AS value FROM customer GROUP BY ALL"
)
_measure("measure_count_by_category", "customer", "c_nationkey", "c_acctbal", "count")
ORACLES["measure_count_by_category"] = (
    "SELECT c_nationkey AS category, count(c_acctbal) AS value FROM customer GROUP BY ALL"
)
_measure("median_by_category", "orders", "o_orderpriority", "o_totalprice", "median")
ORACLES["median_by_category"] = (
    "SELECT o_orderpriority AS category, round(median(o_totalprice), 4) AS value FROM orders GROUP BY ALL"
)
_measure("median_by_part", "lineitem", "l_partkey", "l_extendedprice", "median")
ORACLES["median_by_part"] = (
    "SELECT l_partkey AS category, round(median(l_extendedprice), 4) AS value FROM lineitem GROUP BY ALL"
)
_measure("measure_sum_by_month", "orders", "o_orderdate", "o_totalprice", "sum", by="datetime", grain="month")
ORACLES["measure_sum_by_month"] = """
SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period, round(sum(o_totalprice), 4) AS value
FROM orders GROUP BY ALL
"""
_measure("measure_avg_by_bin", "lineitem", "l_quantity", "l_extendedprice", "avg", by="bins", bins=8)
ORACLES["measure_avg_by_bin"] = """
WITH b AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
SELECT CAST(CASE WHEN l_quantity = hi THEN 7 ELSE floor((l_quantity - lo) / (hi - lo) * 8) END AS INTEGER) AS bucket,
       lo AS min_val, hi AS max_val, round(avg(l_extendedprice), 4) AS value
FROM lineitem, b GROUP BY ALL
"""


def chart_facts_category(spark, sf):
    return facts.chart_facts(charts.category_counts(table(spark, sf, "part"), "p_brand"), "categorical")


QUERIES["chart_facts_category"] = chart_facts_category
ORACLES["chart_facts_category"] = """
WITH c AS (SELECT p_brand AS s, CAST(count(*) AS DOUBLE) AS v FROM part GROUP BY ALL),
top AS (SELECT * FROM c ORDER BY v DESC, s LIMIT 1), low AS (SELECT * FROM c ORDER BY v, s LIMIT 1),
a AS (SELECT sum(v) AS t, avg(v) AS m, stddev_pop(v) AS sd FROM c)
SELECT 0 AS position, 'largest' AS fact, s AS subject, v AS number FROM top
UNION ALL SELECT 1, 'largest_share', s, CAST(format('{:.1f}', v / t * 100) AS DOUBLE) FROM top, a
UNION ALL SELECT 2, 'smallest', s, v FROM low
UNION ALL SELECT 3, 'outlier', s, v FROM top, a WHERE v > m + 2 * sd
"""


def chart_facts_series(spark, sf):
    series = charts.time_series(table(spark, sf, "lineitem"), "l_shipdate", "year")
    return facts.chart_facts(series, "datetime")


QUERIES["chart_facts_series"] = chart_facts_series
ORACLES["chart_facts_series"] = """
WITH c AS (SELECT date_trunc('year', l_shipdate) AS k, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY ALL),
d AS (SELECT strftime(k, '%Y-%m-%d') AS s, k, v FROM c),
top AS (SELECT * FROM d ORDER BY v DESC, k LIMIT 1), low AS (SELECT * FROM d ORDER BY v, k LIMIT 1),
a AS (SELECT sum(v) AS t, avg(v) AS m, stddev_pop(v) AS sd, arg_max(v, k) - arg_min(v, k) AS change FROM d)
SELECT 0 AS position, 'largest' AS fact, s AS subject, v AS number FROM top
UNION ALL SELECT 1, 'largest_share', s, CAST(format('{:.1f}', v / t * 100) AS DOUBLE) FROM top, a
UNION ALL SELECT 2, 'trend', CASE WHEN change > 0 THEN 'up' WHEN change < 0 THEN 'down' ELSE 'flat' END, change FROM a
UNION ALL SELECT 3, 'smallest', s, v FROM low
UNION ALL SELECT 4, 'outlier', s, v FROM top, a WHERE v > m + 2 * sd
"""


def chart_facts_bins(spark, sf):
    return facts.chart_facts(charts.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 10), "numerical_bins")


QUERIES["chart_facts_bins"] = chart_facts_bins
ORACLES["chart_facts_bins"] = f"""
WITH c AS (SELECT bucket AS k, CAST(bucket AS VARCHAR) AS s, CAST(count AS DOUBLE) AS v
           FROM ({_hist_sql('l_extendedprice', 'lineitem', 10)})),
top AS (SELECT * FROM c ORDER BY v DESC, k LIMIT 1), low AS (SELECT * FROM c ORDER BY v, k LIMIT 1),
a AS (SELECT sum(v) AS t, avg(v) AS m, stddev_pop(v) AS sd, sum(v * k) / sum(v) AS mu FROM c),
z AS (SELECT (sum(v * pow(k - mu, 3)) / any_value(t)) / pow(sum(v * pow(k - mu, 2)) / any_value(t), 1.5) AS skew FROM c, a)
SELECT 0 AS position, 'largest' AS fact, s AS subject, v AS number FROM top
UNION ALL SELECT 1, 'largest_share', s, CAST(format('{{:.1f}}', v / t * 100) AS DOUBLE) FROM top, a
UNION ALL SELECT 2, 'skew', CASE WHEN skew > 0.5 THEN 'right' WHEN skew < -0.5 THEN 'left' ELSE 'balanced' END,
                 round(skew, 6) FROM z
UNION ALL SELECT 3, 'smallest', s, v FROM low
UNION ALL SELECT 4, 'outlier', s, v FROM top, a WHERE v > m + 2 * sd
"""


def result_fingerprint(spark, sf):
    counts = charts.category_counts(table(spark, sf, "orders"), "o_orderpriority")
    return facts.result_fingerprint(counts, "o_orderpriority", "pie", "categorical")


QUERIES["result_fingerprint"] = result_fingerprint
ORACLES["result_fingerprint"] = """
WITH c AS (SELECT sha256(o_orderpriority || chr(31) || count(*)) AS h FROM orders GROUP BY o_orderpriority),
p AS (SELECT count(*) AS n, sum(CAST('0x' || h[1:8] AS BIGINT)) AS a, sum(CAST('0x' || h[9:16] AS BIGINT)) AS b,
             sum(CAST('0x' || h[17:24] AS BIGINT)) AS c, sum(CAST('0x' || h[25:32] AS BIGINT)) AS d FROM c)
SELECT sha256(concat_ws(chr(31), 'o_orderpriority', 'pie', 'categorical', 'category,count', n, a, b, c, d)) AS fingerprint
FROM p
"""
