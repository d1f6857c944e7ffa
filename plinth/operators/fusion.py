"""Reciprocal rank fusion of dense and sparse lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators.ranking import keep_first, ranked, top_k


def _positions(hits: DataFrame, score: str) -> DataFrame:
    """(query_id, id, score, rank) with repeats of an id dropped before ranking."""
    once = keep_first(hits, ["query_id", "id"], F.col("rank"))
    return ranked(once, ["query_id"], F.col("rank"), F.col("id"), name="_pos").select("query_id", "id", F.col("score").alias(score), F.col("_pos").alias(f"{score}_rank"))


def fuse(dense: DataFrame, sparse: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """Fuse two lists (query_id, id, score, rank): the sum of 1 / (rrf_k + rank), best ``k``.

    Ties follow the dense order, then the sparse one.  ``source`` tells which lists had the id.
    """
    if rrf_k <= 0:
        raise ValueError("rrf_k must be positive")
    both = _positions(dense, "dense_score").join(_positions(sparse, "sparse_score"), ["query_id", "id"], "full_outer")
    term = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    fused = both.withColumn("fused_score", term("dense_score_rank") + term("sparse_score_rank")).withColumn(
        "source", F.when(F.col("dense_score_rank").isNull(), "sparse").when(F.col("sparse_score_rank").isNull(), "dense").otherwise("hybrid")
    )
    order = [F.round("fused_score", 9).desc(), F.col("dense_score_rank").asc_nulls_last(), F.col("sparse_score_rank").asc_nulls_last()]
    return top_k(fused, k, ["query_id"], *order).select("query_id", "id", "dense_score", "sparse_score", "fused_score", "source", "rank")


def overlap(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """The ids that both lists have, for each query."""
    return dense.select("query_id", "id").intersect(sparse.select("query_id", "id"))


def dense_only(dense: DataFrame, k: int) -> DataFrame:
    """Without sparse hits the fused score is the cosine itself."""
    return top_k(dense.drop("rank"), k, ["query_id"], F.round("score", 9).desc(), F.col("id")).select(
        "query_id", "id", F.col("score").alias("dense_score"), F.lit(None).cast("double").alias("sparse_score"), F.col("score").alias("fused_score"), F.lit("dense").alias("source"), "rank"
    )
