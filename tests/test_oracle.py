"""Every registered query against its SQL counterpart in DuckDB."""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    text, _, _, ok = compare(spark, con, FOLDER, name, QUERIES[name], SQL.get(name))
    assert ok, text


def test_entry(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"claim", "supports", "contradicts", "neutral", "total", "conflicting", "decision"}
    assert df.count() > 0


def test_registry_contract():
    assert set(SQL) <= set(QUERIES)
