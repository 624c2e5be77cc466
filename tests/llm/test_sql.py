"""The training-data queries that SQL can express, against DuckDB on the same tables."""

from __future__ import annotations

import duckdb
import pytest
from conftest import CHECK

from packwright.llm import queries


@pytest.mark.parametrize("key", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, key):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{CHECK}/{table}.parquet')")
    got = queries.QUERIES[key](spark, CHECK)
    want = con.execute(queries.ORACLE_SQL[key])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    ours = sorted(repr(tuple(r)) for r in got.select(names).collect())
    assert ours == sorted(repr(r) for r in want.fetchall())
