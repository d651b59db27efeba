"""Every registered query against its DuckDB counterpart on the smallest tables."""
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield con
    con.close()


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "" if v is None else repr(v) if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    sql = contract.oracle_sql().get(name)
    if sql is not None:
        result = duck.execute(sql)
        columns = [c[0] for c in result.description]
        assert canonical(df.columns, rows) == canonical(columns, result.fetchall())


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 11
