"""Every registered query with SQL against DuckDB on the same tables."""

import math

import duckdb
import pytest

from tests.conftest import SF
from tidepanel import catalog

catalog.load_all()
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if v is not None and type(v).__name__ in ("datetime", "date"):
        return str(v)[:19].replace(" 00:00:00", "")
    return v


def _rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in data), key=lambda t: tuple((x is not None, str(x)) for x in t))


def _same(a, b):
    if len(a) != len(b):
        return False
    for x, y in zip(a, b):
        for p, q in zip(x, y):
            if isinstance(p, float) and isinstance(q, (int, float)):
                if not math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-5):
                    return False
            elif p != q:
                return False
    return True


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rel = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _same(_rows(df.columns, df.collect()), _rows(rel.columns, rel.fetchall()))


def test_every_query_has_a_name_of_the_inventory():
    assert all(n[0] in "acfgjklmnprst" and n[1].isdigit() or n.startswith("k_") for n in catalog.QUERIES)
