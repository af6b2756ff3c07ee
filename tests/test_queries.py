"""Every registered query against its DuckDB statement."""

import re

import pytest

import __spark_entry__ as registered
from checks.compare import connect, differences
from tests.conftest import SMALL

STATEMENTS = registered.oracle_sql()
# The corpus operators have tests of their own.
QUERIES = {n: q for n, q in registered.queries().items() if n != "pipeline" and not re.match(r"op\d+_", n)}


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_query_has_a_statement():
    assert set(QUERIES) <= set(STATEMENTS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equal(spark, duck, name):
    assert differences(spark, duck, SMALL, QUERIES[name], STATEMENTS[name]) is None


def test_all_orders_are_records_on_the_executors(spark, small, monkeypatch):
    def collected(df):
        raise AssertionError("records came to the driver")

    monkeypatch.setattr(registered.rows, "to_records", collected)
    for name in ("records_all", "records_round_trip"):
        assert QUERIES[name](spark, SMALL).count() == small.stg_orders.count() > 0


def test_entry(spark):
    frame = registered.entry(spark)
    assert frame.columns[0] == "order_date" and frame.count() > 0


def test_row_numbers_move_the_bytes_of_the_digest(spark, small, monkeypatch):
    import __spark_entry__ as entry
    from pyspark.sql import functions as F

    given = []
    number = entry.global_row_number
    monkeypatch.setattr(entry, "global_row_number", lambda df, *a: given.append(df) or number(df, *a))
    got = {r.sale_sk: r.position for r in entry.REPORTS["sales_row_number"](small).collect()}
    assert "string" not in dict(given[0].dtypes).values()
    ordered = small.fct_sales.orderBy(F.desc("net_revenue"), "sale_sk").select("sale_sk").collect()
    assert got == {r.sale_sk: n for n, r in enumerate(ordered, 1)}
