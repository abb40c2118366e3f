"""Every registered query against its DuckDB text on the smallest sample folder."""

from __future__ import annotations

import pytest
from compare import compare, oracle_connection, run_oracle, type_mismatch

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
QUERIES, TEXTS = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(FOLDER)


def test_every_oracle_has_a_query():
    assert set(TEXTS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_query_matches_oracle(spark, connection, name):
    df = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    assert compare((df.columns, rows), run_oracle(connection, TEXTS[name])) is None
    wrong = [t for t in type_mismatch(df, connection, TEXTS[name]) if "decimal" not in t]
    assert not wrong


def test_entry(spark):
    assert contract.entry(spark).count() == 12
