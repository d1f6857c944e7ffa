"""Every query that has SQL gives the same rows as the SQL in DuckDB, at the smallest size."""

from __future__ import annotations

import duckdb
import pytest

from plinth.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(str(round(x, 5) + 0.0 if isinstance(x, float) else x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    assert name in SQL
    names = sorted(got.columns)
    mine = [tuple(r) for r in got.select(*names).collect()]
    other = db.execute(f"SELECT {', '.join(names)} FROM ({SQL[name]})").fetchall()
    assert plain(mine) == plain(other)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize(("name", "joins"), [("rerank_overlap", "BroadcastHashJoin [chunk_id"), ("ablation_grid", None)])
def test_texts_are_neither_shuffled_nor_read_again(spark, sf_dir, name, joins):
    """Hits are broadcast to the documents; the grid reads the texts once, before the plan that is returned."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scans = [line for line in plan.splitlines() if "FileScan" in line and "doc_id" in line and "text" in line]
    assert joins in plan and len(scans) == 1 if joins else not scans


@pytest.mark.parametrize(("name", "joins"), [("bm25_topk", 0), ("hybrid_rrf", 1), ("candidate_overlap", 1)])
def test_sparse_hits_take_no_join(spark, sf_dir, name, joins):
    """Documents are scored where they are read; only the best of each question are joined with the dense hits."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in line for line in plan.splitlines()) == joins


@pytest.mark.parametrize(("name", "steps"), [("bm25_topk", 1), ("hybrid_rrf", 2)])
def test_texts_are_scored_in_one_step(spark, sf_dir, name, steps):
    """No postings are made between the texts and the best of each task; the dense search is a step of its own."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("MapInArrow" in line for line in plan.splitlines()) == steps
