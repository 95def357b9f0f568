"""Every registered query that SQL can express, against DuckDB on the same tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entries

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
ORACLES = entries.oracle_sql()


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    return None if x is None else str(x) if not isinstance(x, (int, bool)) else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF_DIR).glob("*.parquet"):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    made = entries.queries()[name](spark, SF_DIR)
    got = made.collect()
    said = duck.execute(ORACLES[name])
    names = [d[0] for d in said.description]
    assert sorted(made.columns) == sorted(names)
    assert rows_of(made.columns, got) == rows_of(names, said.fetchall())


def test_each_oracle_has_its_query():
    assert set(ORACLES) <= set(entries.queries())


def test_entry_runs(spark):
    assert entries.entry(spark).columns
