"""Queries that take all rows of their tables, on rows that a twin of them leaves out."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entries


@pytest.fixture
def tables(tmp_path):
    pq.write_table(pa.table({"n_nationkey": pa.array([0, 1, 2], pa.int32()), "n_name": ["A", "B", "C"]}), tmp_path / "nation.parquet")
    pq.write_table(pa.table({"c_custkey": pa.array([1, 2, 3], pa.int64()), "c_nationkey": pa.array([0, 0, 1], pa.int32()), "c_acctbal": [10.0, 9500.0, None]}), tmp_path / "customer.parquet")
    pq.write_table(pa.table({"s_suppkey": pa.array([7, 8], pa.int64()), "s_nationkey": pa.array([0, 0], pa.int32())}), tmp_path / "supplier.parquet")
    texts = ["plain", "a\xa0b\xa0 \r\nc\xa0", "\xa0", None, '"q"\t\n\xa0\n x']
    pq.write_table(pa.table({"doc_id": pa.array(range(5), pa.int64()), "text": texts, "source": ["web", None, "s", "s\xa0", "x"]}), tmp_path / "documents.parquet")
    return tmp_path


@pytest.mark.parametrize("name,rows", [("r3_03_whole_fan_out_join", 6), ("r9_18_whole_content_fingerprints", 5)])
def test_no_row_is_left_out(spark, tables, name, rows):
    got = sorted(map(tuple, entries.queries()[name](spark, str(tables)).collect()), key=repr)
    con = duckdb.connect()
    for p in tables.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    assert got == sorted(con.execute(entries.oracle_sql()[name]).fetchall(), key=repr) and len(got) == rows
