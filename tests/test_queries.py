"""Every registered query against DuckDB over the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registry

TABLES = Path("/root/testdata/sf0.001")
DUCKDB_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}

pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


LLM = set(registry.llm_queries.queries()) | {"pipeline"} if registry.HAS_LLM else set()


def test_every_query_has_a_check():
    assert set(registry.queries()) - LLM == set(registry.oracle_sql()) - LLM


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, str(TABLES))
    columns = sorted(found.columns)
    sql = registry.oracle_sql()[name]
    described = dict(row[:2] for row in duck.execute(f"DESCRIBE {sql}").fetchall())
    assert described == {column: DUCKDB_TYPES[kind] for column, kind in found.dtypes}
    expected = duck.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    rows = found.select(*columns).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, expected))


def test_entry(spark):
    assert registry.entry(spark).count() == 6
