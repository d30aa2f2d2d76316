"""Every registered query against its SQL, as DuckDB runs it on the same tables."""

from __future__ import annotations

import os

import duckdb
import larkspur.queries_plans  # noqa: F401
import pytest
from larkspur.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or (isinstance(value, float) and value != value):
        return "null"
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    return str([plain(v) for v in value]) if isinstance(value, list | tuple) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    found = con.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = sorted([plain(row[names.index(c)]) for c in columns] for row in found.fetchall())
    assert sorted([plain(row[c]) for c in columns] for row in got.collect()) == expected


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
