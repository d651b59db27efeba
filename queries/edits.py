"""Value edits and the rule tables behind them."""
from __future__ import annotations

from pyspark.sql import functions as F

from queries.common import choose, sql_choose, sql_list, table
from tabsmith.functions.text import regex_replace_all
from tabsmith.operators import edits, frequent, rules
from tabsmith.operators.edits import EditRules, Merge, Replacement

QUERIES, ORACLES = {}, {}

URGENT = Merge("URGENT", ["1-URGENT", "2-HIGH"])
CALM = Merge("CALM", ["4-NOT SPECIFIED", "5-LOW"])


def replace_literal(spark, sf):
    two = EditRules().with_replacement("p_name", Replacement("red", "crimson"))
    two = two.with_replacement("p_name", Replacement("crimson w", "dark w"))
    return edits.apply_edits(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), two)


QUERIES["replace_literal"] = replace_literal
ORACLES["replace_literal"] = """
SELECT p_partkey, replace(replace(p_name, 'red', 'crimson'), 'crimson w', 'dark w') AS p_name, p_size FROM part
"""


def replace_regex(spark, sf):
    rule = Replacement(r"^([A-Z])[a-z]+#0*(\d)", r"\1-$\2", is_regex=True)
    return edits.apply_edits(
        table(spark, sf, "customer").select("c_custkey", "c_name"), EditRules().with_replacement("c_name", rule)
    )


QUERIES["replace_regex"] = replace_regex
ORACLES["replace_regex"] = r"""
SELECT c_custkey, regexp_replace(c_name, '^([A-Z])[a-z]+#0*(\d)', '\1-$\2', 'g') AS c_name FROM customer
"""


def replace_regex_classes(spark, sf):
    """Forms whose meaning differs between regular expression dialects."""
    text = F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, "\n12").otherwise(" 12\n")).alias("c_name")
    rules = EditRules()
    for find, put in (("[[:alpha:]]+#", "C-"), ("12$", "end"), ("(?U)0+", "o"), (r"\(?(?P<d>[1-4])\)?", r"<\1>")):
        rules = rules.with_replacement("c_name", Replacement(find, put, is_regex=True))
    return edits.apply_edits(table(spark, sf, "customer").select("c_custkey", text), rules)


QUERIES["replace_regex_classes"] = replace_regex_classes
ORACLES["replace_regex_classes"] = r"""
WITH t AS (SELECT c_custkey, c_name || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || '12' ELSE ' 12' || chr(10) END AS c_name FROM customer)
SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(c_name, '[[:alpha:]]+#', 'C-', 'g'), '12$', 'end', 'g'),
       '(?U)0+', 'o', 'g'), '\(?(?P<d>[1-4])\)?', '<\1>', 'g') AS c_name FROM t
"""


# Patterns that most dialects read differently, each with its replacement.
DIALECT = [
    ("0*", "z"), ("(?i)é", "e"), ("(?i)S", "ss"), ("(?m)^", ">"), (r"\b", "|"), (r"\p{Greek}+", r"<\0>"), (r"(?U)([[:alpha:]]+)(\d?)", r"\2\1"),
    (r"[^\pL\s]", "."), (r"(?:\s|$)", "_"),
]


def replace_regex_dialect(spark, sf):
    """One column per pattern; names carry accents, Greek, line ends and characters outside the basic plane."""
    more = F.element_at(F.array(*[F.lit(t) for t in ("É ſ", "αΒ\n", "\U0001d400é\n\nStraße", " x é")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    named = table(spark, sf, "customer").select("c_custkey", F.concat("c_name", more).alias("name"))
    return named.select("c_custkey", *[regex_replace_all(F.col("name"), find, put).alias(f"r{k}") for k, (find, put) in enumerate(DIALECT)])


QUERIES["replace_regex_dialect"] = replace_regex_dialect
ORACLES["replace_regex_dialect"] = """
WITH t AS (SELECT c_custkey, c_name || (['É ſ', 'αΒ' || chr(10), '\U0001d400é' || chr(10) || chr(10) || 'Straße', ' x é'])[c_custkey % 4 + 1] AS name FROM customer)
SELECT c_custkey, """ + ", ".join(f"regexp_replace(name, '{find}', '{put}', 'g') AS r{k}" for k, (find, put) in enumerate(DIALECT)) + " FROM t"


def edit_number_as_text(spark, sf):
    """A number with a rule reads as text, in positional notation."""
    rule = EditRules().with_replacement("o_totalprice", Replacement(".", ","))
    return edits.apply_edits(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), rule)


QUERIES["edit_number_as_text"] = edit_number_as_text
ORACLES["edit_number_as_text"] = (
    "SELECT o_orderkey, replace(CAST(o_totalprice AS VARCHAR), '.', ',') AS o_totalprice FROM orders"
)


def merge_values(spark, sf):
    merged = edits.apply_edits(table(spark, sf, "orders"), EditRules().with_merge("o_orderpriority", URGENT, CALM))
    return merged.select("o_orderkey", "o_orderpriority")


QUERIES["merge_values"] = merge_values
ORACLES["merge_values"] = """
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'URGENT'
                        WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'CALM'
                        ELSE o_orderpriority END AS o_orderpriority
FROM orders
"""


def replace_then_merge(spark, sf):
    """Merges see replaced text."""
    both = EditRules().with_replacement("o_orderpriority", Replacement(r"^\d-", "", is_regex=True))
    both = both.with_merge("o_orderpriority", Merge("SOON", ["URGENT", "HIGH"]))
    return edits.value_counts(edits.apply_edits(table(spark, sf, "orders"), both), "o_orderpriority")


QUERIES["replace_then_merge"] = replace_then_merge
ORACLES["replace_then_merge"] = r"""
WITH t AS (SELECT regexp_replace(o_orderpriority, '^\d-', '', 'g') AS x FROM orders)
SELECT CASE WHEN x IN ('URGENT', 'HIGH') THEN 'SOON' ELSE x END AS value, count(*) AS count FROM t GROUP BY ALL
"""

# Three hundred sources: past the inline limit, so the merge is a join.
MANY = [f"Supplier#{i:09d}" for i in range(0, 600, 2)]


def merge_many_values(spark, sf):
    rule = EditRules().with_merge("s_name", Merge("even supplier", MANY))
    named = table(spark, sf, "supplier").withColumns({"_source": F.lit("own"), "_target": F.col("s_suppkey")})
    return edits.apply_edits(named, rule).select("s_suppkey", "s_name", "_source", "_target")


QUERIES["merge_many_values"] = merge_many_values
ORACLES["merge_many_values"] = f"""
SELECT s_suppkey, CASE WHEN s_name IN ({sql_list(MANY)}) THEN 'even supplier' ELSE s_name END AS s_name,
       'own' AS _source, s_suppkey AS _target FROM supplier
"""

QUERIES["value_counts"] = lambda spark, sf: edits.value_counts(table(spark, sf, "part"), "p_name", 20)
ORACLES["value_counts"] = (
    "SELECT p_name AS value, count(*) AS count FROM part GROUP BY ALL ORDER BY count DESC, value LIMIT 20"
)
# More values than any screen shows: the limit asked for holds.
QUERIES["value_counts_many"] = lambda spark, sf: edits.value_counts(table(spark, sf, "orders"), "o_totalprice", 6000)
ORACLES["value_counts_many"] = """
SELECT CAST(o_totalprice AS VARCHAR) AS value, count(*) AS count FROM orders GROUP BY ALL ORDER BY count DESC, value LIMIT 6000
"""
QUERIES["distinct_count"] = lambda spark, sf: edits.distinct_count(table(spark, sf, "part"), "p_name")
ORACLES["distinct_count"] = "SELECT count(DISTINCT p_name) AS distinct_count FROM part"


def replacement_effect(spark, sf):
    return edits.replacement_effect(table(spark, sf, "part"), "p_name", Replacement("(red|blue).*", "red widget", True))


QUERIES["replacement_effect"] = replacement_effect
ORACLES["replacement_effect"] = """
SELECT count(*) AS rows_affected FROM part
WHERE p_name IS DISTINCT FROM regexp_replace(p_name, '(red|blue).*', 'red widget', 'g')
"""


def merge_effect(spark, sf):
    groups = [Merge("1-URGENT", ["1-URGENT", "2-HIGH"]), Merge("REST", ["4-NOT SPECIFIED", "5-LOW", "no such value"])]
    return edits.merge_effect(table(spark, sf, "orders"), "o_orderpriority", groups)


QUERIES["merge_effect"] = merge_effect
ORACLES["merge_effect"] = """
SELECT '1-URGENT' AS target, count(*) AS rows_affected FROM orders WHERE o_orderpriority = '2-HIGH'
UNION ALL
SELECT 'REST', count(*) FROM orders WHERE o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW')
"""


def preview_edit(spark, sf):
    orders = table(spark, sf, "orders")
    trial = edits.apply_edits(orders, EditRules().with_merge("o_orderpriority", URGENT))
    return edits.preview_edit(orders, "o_orderpriority", trial)


QUERIES["preview_distinct"] = lambda spark, sf: edits.distinct_counts(preview_edit(spark, sf))
ORACLES["preview_distinct"] = """
SELECT count(DISTINCT o_orderpriority) AS distinct_before,
       count(DISTINCT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'URGENT' ELSE o_orderpriority END) AS distinct_after
FROM orders
"""


QUERIES["preview_edit"] = preview_edit
ORACLES["preview_edit"] = """
WITH b AS (SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY ALL),
a AS (SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'URGENT' ELSE o_orderpriority END AS value,
             count(*) AS n FROM orders GROUP BY ALL)
SELECT coalesce(b.value, a.value) AS value, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after
FROM b FULL JOIN a ON a.value = b.value
"""

# Catalog-wide rule tables. Stored rules come from customers (a nation is a dataset, a value belongs
# to one market segment), the new batch from orders.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
TARGETS = [*SEGMENTS, "NEW A", "NEW B"]


def _stored_merges(spark, sf):
    owned = table(spark, sf, "customer").groupBy(
        F.concat(F.lit("d"), "c_nationkey").alias("dataset"), F.concat(F.lit("v"), F.col("c_custkey") % 200).alias("source")
    ).agg(F.max_by("c_mktsegment", "c_custkey").alias("target"))
    seq = F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("target"))
    return owned.select(
        "dataset", F.lit("segment").alias("column"), "target", "source",
        seq.cast("bigint").alias("seq"), (seq * 10).cast("bigint").alias("rows_affected"),
    )


_STORED_SQL = f"""
SELECT 'd' || c_nationkey AS dataset, 'segment' AS "column", arg_max(c_mktsegment, c_custkey) AS target,
       'v' || (c_custkey % 200) AS source,
       CAST(list_position([{sql_list(SEGMENTS)}], arg_max(c_mktsegment, c_custkey)) AS BIGINT) AS seq,
       CAST(list_position([{sql_list(SEGMENTS)}], arg_max(c_mktsegment, c_custkey)) * 10 AS BIGINT) AS rows_affected
FROM customer GROUP BY dataset, source
"""


def _new_merges(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("d"), F.col("o_custkey") % 25).alias("dataset"),
        F.lit("segment").alias("column"),
        choose(TARGETS, k).alias("target"),
        F.concat(F.lit("v"), F.floor(k / 7) % 120).alias("source"),
        (k % 7 + 100).alias("seq"),
        (k % 7 + 3).alias("rows_affected"),
    ).distinct()


_NEW_SQL = f"""
SELECT DISTINCT 'd' || (o_custkey % 25) AS dataset, 'segment' AS "column",
       {sql_choose([f"'{t}'" for t in TARGETS], 'o_orderkey')} AS target,
       'v' || ((o_orderkey // 7) % 120) AS source, o_orderkey % 7 + 100 AS seq, o_orderkey % 7 + 3 AS rows_affected
FROM orders
"""

QUERIES["add_merges"] = lambda spark, sf: rules.add_merges(_stored_merges(spark, sf), _new_merges(spark, sf))
ORACLES["add_merges"] = f"""
WITH old AS ({_STORED_SQL}), new AS ({_NEW_SQL}),
kept AS (SELECT * FROM old WHERE NOT EXISTS (
    SELECT 1 FROM new WHERE new.dataset = old.dataset AND new.source = old.source)),
added AS (SELECT dataset, target, min(seq) AS seq, sum(rows_affected) AS n
          FROM (SELECT DISTINCT dataset, target, seq, rows_affected FROM new) GROUP BY ALL),
alive AS (SELECT dataset, target, min(seq) AS seq, max(rows_affected) AS n FROM kept GROUP BY ALL),
rule AS (SELECT coalesce(alive.dataset, added.dataset) AS dataset, coalesce(alive.target, added.target) AS target,
                coalesce(alive.seq, added.seq) AS seq, coalesce(alive.n, 0) + coalesce(added.n, 0) AS n
         FROM alive FULL JOIN added ON alive.dataset = added.dataset AND alive.target = added.target),
src AS (SELECT dataset, target, source FROM kept UNION SELECT dataset, target, source FROM new)
SELECT src.dataset, 'segment' AS "column", src.target, src.source, CAST(rule.seq AS BIGINT) AS seq,
       CAST(rule.n AS BIGINT) AS rows_affected
FROM src JOIN rule ON src.dataset = rule.dataset AND src.target = rule.target
"""


def apply_merge_table(spark, sf):
    """Stored merges applied to the values of every dataset in one join."""
    values = table(spark, sf, "customer").select(
        F.concat(F.lit("d"), F.col("c_nationkey")).alias("dataset"), F.lit("segment").alias("column"),
        F.concat(F.lit("v"), F.col("c_custkey") % 300).alias("value"), "c_custkey",
    )
    return rules.apply_merge_table(values, _stored_merges(spark, sf))


QUERIES["apply_merge_table"] = apply_merge_table
ORACLES["apply_merge_table"] = f"""
WITH r AS ({_STORED_SQL})
SELECT 'd' || c_nationkey AS dataset, 'segment' AS "column", coalesce(r.target, 'v' || (c_custkey % 300)) AS value, c_custkey
FROM customer LEFT JOIN r ON r.dataset = 'd' || c_nationkey AND r.source = 'v' || (c_custkey % 300)
"""


def validate_groups(spark, sf):
    """Proposed sources that do occur among a nation's customers; every fifth target is blank."""
    k = F.col("o_orderkey")
    groups = table(spark, sf, "orders").select(
        F.concat(F.lit("d"), F.col("o_custkey") % 25).alias("dataset"), F.lit("segment").alias("column"), k.alias("group_id"),
        choose([" A ", "B", "C", "D", " "], k).alias("target"), F.concat(F.lit("v"), k % 400).alias("source"),
    )
    values = table(spark, sf, "customer").select(
        F.concat(F.lit("d"), F.col("c_nationkey")).alias("dataset"), F.lit("segment").alias("column"),
        F.concat(F.lit("v"), F.col("c_custkey") % 250).alias("value"),
    )
    return rules.validate_groups(groups, values)


QUERIES["validate_groups"] = validate_groups
ORACLES["validate_groups"] = f"""
WITH g AS (SELECT 'd' || (o_custkey % 25) AS dataset, 'segment' AS "column", o_orderkey AS group_id,
                  trim({sql_choose(["' A '", "'B'", "'C'", "'D'", "' '"], 'o_orderkey')}) AS target,
                  'v' || (o_orderkey % 400) AS source FROM orders)
SELECT * FROM g WHERE target <> '' AND (dataset, source) IN (
    SELECT ('d' || c_nationkey, 'v' || (c_custkey % 250)) FROM customer)
"""


def _replacement_rules(spark, sf, name, key, of):
    k = F.col(key)
    return table(spark, sf, name).groupBy(
        F.concat(F.lit("d"), F.col(of) % 25).alias("dataset"), F.lit("note").alias("column"),
        F.concat(F.lit("f"), k % 40).alias("find"),
    ).agg(F.max(k).alias("seq")).select(
        "dataset", "column", "find", F.concat(F.lit("r"), F.col("seq")).alias("replace"),
        (F.col("seq") % 2 == 0).alias("is_regex"), "seq", (F.col("seq") % 9).alias("rows_affected"),
    )


def add_replacement(spark, sf):
    stored = _replacement_rules(spark, sf, "customer", "c_custkey", "c_nationkey")
    fresh = _replacement_rules(spark, sf, "orders", "o_orderkey", "o_custkey").withColumns({
        "seq": F.col("seq") + 10**12, "find": F.replace("find", F.lit("f3"), F.lit("g3"))})
    return rules.add_replacement(stored, fresh)


_REPLACEMENT_SQL = """
SELECT 'd' || ({of} % 25) AS dataset, 'note' AS "column", 'f' || ({key} % 40) AS find, max({key}) AS seq
FROM {name} GROUP BY ALL
"""
QUERIES["add_replacement"] = add_replacement
ORACLES["add_replacement"] = f"""
WITH a AS ({_REPLACEMENT_SQL.format(name='customer', key='c_custkey', of='c_nationkey')}),
b AS ({_REPLACEMENT_SQL.format(name='orders', key='o_orderkey', of='o_custkey')}),
u AS (SELECT dataset, "column", find, seq, seq AS k FROM a
      UNION ALL SELECT dataset, "column", replace(find, 'f3', 'g3'), seq + 1000000000000, seq FROM b),
w AS (SELECT *, row_number() OVER (PARTITION BY dataset, "column", find ORDER BY seq DESC) AS i FROM u)
SELECT dataset, "column", find, 'r' || k AS replace, k % 2 = 0 AS is_regex, seq, k % 9 AS rows_affected FROM w WHERE i = 1
"""


def revert_merge(spark, sf):
    stored = _stored_merges(spark, sf)
    first = stored.agg(F.min(F.struct("dataset", "target")).alias("r")).first()["r"]
    return rules.revert_merge(stored, first["dataset"], "segment", first["target"])


QUERIES["revert_merge"] = revert_merge
ORACLES["revert_merge"] = f"""
WITH a AS ({_STORED_SQL})
SELECT * FROM a WHERE (dataset, target) <> (SELECT (dataset, target) FROM a ORDER BY dataset, target LIMIT 1)
"""


def revert_replacement(spark, sf):
    stored = _replacement_rules(spark, sf, "customer", "c_custkey", "c_nationkey")
    return rules.revert_replacement(stored, "d3", "note", stored.filter("dataset = 'd3'").agg(F.min("find")).first()[0])


QUERIES["revert_replacement"] = revert_replacement
ORACLES["revert_replacement"] = f"""
WITH a AS ({_REPLACEMENT_SQL.format(name='customer', key='c_custkey', of='c_nationkey')})
SELECT dataset, "column", find, 'r' || seq AS replace, seq % 2 = 0 AS is_regex, seq, seq % 9 AS rows_affected FROM a
WHERE NOT (dataset = 'd3' AND find = (SELECT min(find) FROM a WHERE dataset = 'd3'))
"""


def winning_merges(spark, sf):
    """Where one batch names a source under several targets, the first rule applies."""
    return rules.winning_merges(_new_merges(spark, sf))


QUERIES["winning_merges"] = winning_merges
ORACLES["winning_merges"] = f"""
SELECT dataset, "column", source, arg_min(target, seq) AS target FROM ({_NEW_SQL}) GROUP BY ALL
"""


def top_values(spark, sf):
    """The most frequent customers, prices (which hardly repeat) and words of the documents' first lines."""
    orders = table(spark, sf, "orders")
    words = table(spark, sf, "documents").select(F.explode(F.split(F.split_part("text", F.lit("\n"), F.lit(1)), " ")).alias("word"))
    found = [(orders, "o_custkey", 50), (orders, "o_totalprice", 200), (words.filter("word <> ''"), "word", 200)]
    parts = [frequent.top_values(df, name, n).select(F.lit(name).alias("name"), F.col("value").cast("string").alias("value"), "count") for df, name, n in found]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("name", F.when(F.col("name") != "o_totalprice", F.col("value")).alias("value"), "count")


QUERIES["top_values"] = top_values
ORACLES["top_values"] = " UNION ALL ".join(
    f"""SELECT '{name}' AS name, {shown} AS value, count FROM (
    SELECT {name} AS value, count(*) AS count FROM {source} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {n})"""
    for name, shown, source, n in (
        ("o_custkey", "CAST(value AS VARCHAR)", "orders", 50), ("o_totalprice", "NULL", "orders", 200),
        ("word", "value", "(SELECT word FROM (SELECT unnest(string_split(string_split(text, chr(10))[1], ' ')) AS word FROM documents) WHERE word <> '')", 200)))
