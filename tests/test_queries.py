"""Every registered query against its SQL, and the driver contract."""

import pytest

import __spark_entry__ as contract
from compare import connect, difference
from newstide.catalog.oracle import oracle_sql
from newstide.catalog.queries import QUERIES

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con(sf_small):
    connection = connect(sf_small)
    yield connection
    connection.close()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_contract_registers_every_query():
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() == 15
    assert df.columns[:2] == ["symbol", "window"]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, sf_small, name):
    assert difference(spark, con, QUERIES[name], SQL[name], sf_small) is None


@pytest.mark.parametrize("name", list(QUERIES))
def test_queries_return_rows(con, name):
    assert con.execute(f"SELECT count(*) FROM ({SQL[name]})").fetchone()[0] > 0
