"""Every registered query of the image engine against DuckDB."""

import os

import duckdb
import pytest

from tests.conftest import DATA
from wavegrid.plans.oracle import ORACLE_SQL
from wavegrid.plans.queries import QUERIES

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a = sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect())))
    rows = want.df().astype(object)
    rows = rows.where(rows.notna(), None)
    b = sorted(map(repr, (tuple(x.item() if hasattr(x, "item") else x for x in (r[c] for c in columns)) for _, r in rows.iterrows())))
    assert len(a) > 0
    assert a == b
