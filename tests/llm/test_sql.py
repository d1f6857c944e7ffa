"""The queries that have SQL give the same rows as DuckDB; the others run."""

from __future__ import annotations

import duckdb
import pytest

from plinth.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    names = sorted(got.columns)
    mine = [tuple(r) for r in got.select(*names).collect()]
    if name not in ORACLE_SQL:
        assert mine
        return
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    other = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, mine)) == sorted(map(str, other))
