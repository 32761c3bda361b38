"""Registered training-data queries against their DuckDB SQL, on whole tables."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF001
from tools.oracle_check import _rows
from tillroll.llm.oracle import oracle_queries
from tillroll.llm.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(oracle_queries()))
def test_query_matches_oracle(spark, con, name):
    spdf = E.queries()[name](spark, SF001).toPandas()
    dpdf = con.sql(E.oracle_sql()[name]).df()
    assert sorted(spdf.columns) == sorted(dpdf.columns)
    assert _rows(spdf, 9) == _rows(dpdf, 9)


def test_all_thirteen_are_registered():
    names = set(E.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
