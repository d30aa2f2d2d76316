"""The queries on streams where the table is a folder of parts, as large tables are, against their SQL."""

from __future__ import annotations

import duckdb
import larkspur.queries_plans  # noqa: F401
import pytest
from larkspur.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", ["session_expiry", "session_stream", "streamed_artifacts"])
def test_a_folder_of_parts(spark, tmp_path, name):
    path = f"{tmp_path}/conversations.parquet"
    spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").repartition(3).write.parquet(path)
    got = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    expected = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE[name]})").fetchall()
    assert expected and sorted(map(tuple, got.collect())) == sorted(expected)
