import pytest

from tabsmith.operators.edits import EditRules, Merge, apply_edits
from tabsmith.plans.query import UnsafeQueryError, query, run_query


@pytest.mark.parametrize("text", [
    "SELECT count(*) AS n FROM data", "WITH t AS (SELECT * FROM data) SELECT count(*) AS n FROM t;",
    'SELECT count("city") AS n FROM data -- all of them', "SELECT n FROM (SELECT count(*) AS n FROM data) ORDER BY n",
])
def test_reads_are_allowed(cities, text):
    assert query(cities, text).first()["n"] == 150


@pytest.mark.parametrize("text", [
    "DROP TABLE data", "DELETE FROM data", "INSERT INTO data VALUES (1)", "SELECT 1; SELECT 2", "SELECT FROM WHERE", "",
    "CREATE TABLE t AS SELECT 1", "SET a=b", "SELECT nothing FROM data",
])
def test_everything_else_is_refused(cities, text):
    with pytest.raises(UnsafeQueryError):
        query(cities, text)


def test_files_cannot_be_read(cities, tmp_path):
    cities.write.parquet(str(tmp_path / "p"))
    with pytest.raises(UnsafeQueryError):
        query(cities, f"SELECT * FROM parquet.`{tmp_path}/p`")


def test_rows_are_capped_and_flagged(cities):
    columns, rows, truncated = run_query(cities, "SELECT id FROM data ORDER BY id DESC", 10)
    assert columns == ["id"] and [r[0] for r in rows] == list(range(149, 139, -1)) and truncated
    assert not run_query(cities, "SELECT id FROM data", 150)[2]


def test_queries_see_edited_values_and_leave_no_view(spark, cities):
    edited = apply_edits(cities, EditRules().with_merge("city", Merge("CGN", ["Koeln", "Cologne"])))
    assert query(edited, "SELECT count(*) AS n FROM data WHERE city = 'CGN'").first()["n"] == 40
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("data")]
    assert spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers", "false") == "false"


@pytest.mark.parametrize("text", [
    "SELECT java_method('java.lang.System', 'getProperty', 'x') AS n FROM data", "SELECT `reflect`('java.lang.System', 'gc') FROM data",
    "SELECT try_reflect /* */ ('java.lang.System', 'gc') FROM data", "SELECT * FROM secret", "SELECT (SELECT max(id) FROM secret) FROM data",
    "WITH a AS (SELECT * FROM secret) SELECT * FROM a", "SELECT * FROM data WHERE id IN (SELECT id FROM secret)",
])
def test_java_methods_and_other_views_are_refused(spark, cities, text):
    spark.range(3).createOrReplaceTempView("secret")
    with pytest.raises(UnsafeQueryError):
        query(cities, text)


def test_a_frame_over_a_view_may_read_it(spark):
    spark.range(3).createOrReplaceTempView("own")
    assert query(spark.table("own"), "SELECT count(*) AS n FROM data").first()["n"] == 3


JAVA = "'java.lang.System', 'setProperty', 'tabsmith.probe', 'yes'"


@pytest.mark.parametrize("text", [
    f"SELECT IDENTIFIER('java_' || 'method')({JAVA}) FROM data", f"SELECT id FROM data WHERE IDENTIFIER('ref' || 'lect')({JAVA}) IS NOT NULL",
    f"SELECT sum(id) OVER w FROM data WINDOW w AS (PARTITION BY try_reflect({JAVA}))", f"SELECT upper(coalesce(java_method({JAVA}), 'x')) FROM data",
    f"SELECT transform(array(1), x -> reflect({JAVA})) FROM data", f"SELECT id FROM data ORDER BY java_method({JAVA})",
    f"SELECT (SELECT max(system.builtin.reflect({JAVA})) FROM data) FROM data", f"SELECT * FROM VALUES (java_method({JAVA}))",
    f"SELECT mode() WITHIN GROUP (ORDER BY java_method({JAVA})) FROM data", f"SELECT nvl(try_reflect({JAVA}), 'x') FROM data",
    "SELECT input_file_name() FROM data", "SELECT own_python(id) FROM data", "SELECT * FROM IDENTIFIER('sec' || 'ret')",
    "SELECT * FROM data, LATERAL (SELECT * FROM secret)", "SELECT id FROM data EXCEPT SELECT id FROM secret", "SELECT * FROM python_worker_logs()",
])
def test_unsafe_plans_are_refused_before_anything_runs(spark, cities, text):
    spark.range(3).createOrReplaceTempView("secret")
    spark.udf.register("own_python", lambda x: x)
    with pytest.raises(UnsafeQueryError):
        query(cities, text).collect()
    assert spark._jvm.java.lang.System.getProperty("tabsmith.probe") is None


@pytest.mark.parametrize("text", [
    "SELECT 'reflect' AS n FROM data LIMIT 1", "SELECT reflect AS n FROM (SELECT 'reflect' AS reflect FROM data) LIMIT 1", "SELECT /* java_method( */ 'reflect' AS n -- try_reflect",
    "SELECT max(CASE WHEN city LIKE 'K%' THEN 'reflect' END) FILTER (WHERE id IS NOT NULL) AS n FROM data", "SELECT n FROM (VALUES ('reflect')) AS t(n)",
    "WITH RECURSIVE r(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM r WHERE k < 5) SELECT if(count(*) = 5, 'reflect', '') AS n FROM r",
    "SELECT first(n) AS n FROM (SELECT explode(array('reflect')) AS n, row_number() OVER (PARTITION BY city ORDER BY id) AS k, approx_count_distinct(city) OVER () AS d FROM data)",
    "SELECT lpad(substring(to_json(named_struct('a', array_max(collect_list('reflect')))), 7, 7), 7, ' ') AS n FROM data",
    "SELECT any_value(n) AS n FROM (SELECT 'reflect' AS n, percentile_approx(amount, 0.5), date_trunc('month', current_date()), round(avg(amount), 2), try_divide(1, 0), typeof(1), left('abc', 2) FROM data GROUP BY ROLLUP (city) HAVING count(*) > 0)",
    "SELECT d.n FROM (SELECT 'reflect' AS n, city FROM data) AS d SEMI JOIN data USING (city) WHERE d.city IN (SELECT city FROM data) AND EXISTS (SELECT 1 FROM data AS e WHERE e.city = d.city) LIMIT 1",
    "SELECT n FROM (SELECT city, 'reflect' AS n, id FROM data) PIVOT (max(id) FOR city IN ('Koeln')) LIMIT 1",
])
def test_harmless_texts_are_accepted(cities, text):
    assert query(cities, text).first()["n"] == "reflect"
