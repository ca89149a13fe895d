"""Every registered query against its SQL counterpart in DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver
from workload import oracle as workload_oracle
from workload import queries as workload_queries

QUERIES = driver.queries()
ORACLE = driver.oracle_sql()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_a_counterpart():
    assert workload_queries.queries().keys() == workload_oracle.oracle_sql().keys()
    assert ORACLE.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", ORACLE)
def test_same_result(spark, oracle, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(str(tuple(row)) for row in df.select(*columns).collect())
    cursor = oracle.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted(str(tuple(row[i] for i in order)) for row in cursor.fetchall())
    assert got == expected


ORDERS = {
    "ordered_lines": "month, surname, name, category_rank, settlement_id, item_id",
    "ordered_control": """CASE WHEN pension_ctrl <> 0 AND health_ctrl = 0 THEN 1 ELSE 0 END, pension_ctrl DESC, health_ctrl DESC,
  surname, name, tax_id""",
}
KEYS = {
    "ordered_lines": ("month", "surname", "name", "category_rank", "settlement_id", "item_id"),
    "ordered_control": ("pension_ctrl", "health_ctrl", "surname", "name", "tax_id"),
}


@pytest.mark.parametrize("name", ORDERS)
def test_same_order(spark, oracle, sf, name):
    """What an order is for: the rows come in the order that SQL gives them."""
    got = [tuple(row) for row in QUERIES[name](spark, sf).select(*KEYS[name]).collect()]
    expected = oracle.execute(f"SELECT {', '.join(KEYS[name])} FROM ({ORACLE[name]}) ORDER BY {ORDERS[name]}").fetchall()
    assert got == expected


def test_some_controls_differ_only_in_the_end_of_the_health_plan(oracle):
    """Else the counterpart could not tell whether plans are cut before or after rows are told apart."""
    rows = oracle.execute(ORACLE["withholding_control_april"]).fetchall()
    assert len(set(rows)) < len(rows)


def test_entry(spark):
    df = driver.entry(spark)
    assert df.count() > 0 and len(df.columns) == 46
