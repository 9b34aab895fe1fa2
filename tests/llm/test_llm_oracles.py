"""Operators with SQL against DuckDB, and the registration itself."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.llm.conftest import SF
from tests.test_oracles import TABLES, _rows, _same
from tidepanel.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df, rel = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _same(_rows(df.columns, df.collect()), _rows(rel.columns, rel.fetchall()))


def test_all_ten_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
