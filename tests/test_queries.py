"""Every registered query against DuckDB on the same tables: names, row count and values."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from conftest import CHECK


def _value(v):
    return repr(v) if isinstance(v, float) else str(v)


def _canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_value(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{CHECK}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    yield con
    con.close()


# The training-data queries, where installed, are tested beside their operators.
KEYS = sorted(k for k in contract.queries() if k != "pipeline" and not k.startswith("op"))


def test_every_query_has_sql():
    assert set(KEYS) <= set(contract.oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_matches_sql(spark, duck, key):
    got = contract.queries()[key](spark, CHECK)
    want = duck.execute(contract.oracle_sql()[key])
    names = [d[0] for d in want.description]
    ours = _canonical(got.columns, [tuple(r) for r in got.collect()])
    assert ours == _canonical(names, want.fetchall())


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.count() == 1000
    assert [f.name for f in rows.schema.fields][-1] == "dt"
