"""Context assembly: small chunks are shown as their parents, once each, within a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plinth.functions.text import BLOCK_SEPARATOR, context_block, is_cited, token_count
from plinth.operators.ranking import keep_first, ranked


def display(matches: DataFrame, chunks: DataFrame, use_parents: bool = True) -> DataFrame:
    """``matches`` (query_id, chunk_id, rank) with the labels of the match and the id and code that are shown.

    The parent stands in if it is stored; an unknown chunk id is an error.
    """
    own = matches.join(chunks, "chunk_id", "left").withColumn("chunk_id", F.when(F.col("file_id").isNotNull(), F.col("chunk_id")).otherwise(F.raise_error(F.concat(F.lit("unknown chunk "), F.col("chunk_id").cast("string")))))
    parent = chunks.select(F.col("chunk_id").alias("parent_chunk_id"), F.col("raw_code").alias("_code"))
    wide = own.join(parent, "parent_chunk_id", "left")
    use = F.col("_code").isNotNull() if use_parents else F.lit(False)
    return wide.withColumns({"display_id": F.when(use, F.col("parent_chunk_id")).otherwise(F.col("chunk_id")), "display_code": F.when(use, F.col("_code")).otherwise(F.col("raw_code"))}).drop("_code")


def within_budget(blocks: DataFrame, budget: int, order: str = "rank") -> DataFrame:
    """The prefix of blocks (query_id, rank, tokens) that fits; the first block always stays.

    Every block but the first also pays for the separator.  Column ``truncated`` tells if any block went.
    """
    if budget <= 0:
        raise ValueError("budget must be positive")
    gap = -(-len(BLOCK_SEPARATOR) // 4)
    w = W.partitionBy("query_id").orderBy(order)
    whole = W.partitionBy("query_id")
    cost = blocks.withColumn("_n", F.row_number().over(w)).withColumn("_cost", F.col("tokens") + F.when(F.col("_n") > 1, gap).otherwise(0))
    run = cost.withColumn("_run", F.sum("_cost").over(w.rowsBetween(W.unboundedPreceding, 0)))
    cut = run.withColumn("_cut", F.min(F.when((F.col("_run") > budget) & (F.col("_n") > 1), F.col("_n"))).over(whole))
    # an oversized first block ends the prefix too
    over_first = F.max(F.when((F.col("_n") == 1) & (F.col("_run") > budget), 1).otherwise(0)).over(whole)
    kept = cut.withColumn("_over", over_first).withColumn("truncated", F.col("_cut").isNotNull())
    return kept.where((F.col("_n") == 1) | ((F.col("_over") == 0) & (F.col("_cut").isNull() | (F.col("_n") < F.col("_cut"))))).drop("_n", "_cost", "_run", "_cut", "_over")


def build(matches: DataFrame, chunks: DataFrame, repository_id: str, budget: int = 4000, use_parents: bool = True) -> DataFrame:
    """One row for each query: context text, its tokens, the shown ids, and whether blocks were cut."""
    shown = keep_first(display(matches, chunks, use_parents), ["query_id", "display_id"], F.col("rank"))
    text = context_block(F.lit(repository_id), F.col("file_path"), F.col("language"), F.col("chunk_type"), F.col("function_name"), F.col("class_name"), F.col("display_code"))
    blocks = shown.withColumn("block", text).withColumn("tokens", token_count(F.col("block")))
    kept = within_budget(blocks, budget)
    gathered = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block", "display_id", "chunk_id"))).alias("b"), F.max("truncated").alias("truncated"))  # bounded by the budget
    joined = F.array_join(F.transform("b", lambda x: x["block"]), BLOCK_SEPARATOR)
    return gathered.select("query_id", joined.alias("context"), token_count(joined).alias("total_tokens"), F.transform("b", lambda x: x["display_id"]).alias("display_ids"), F.transform("b", lambda x: x["chunk_id"]).alias("chunk_ids"), "truncated")


def citations(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of candidates (query_id, chunk_id, file_path, function_name, class_name) that the answer names."""
    return candidates.join(answers, "query_id").where(is_cited(F.col("answer"), F.col("file_path"), F.col("function_name"), F.col("class_name"))).select("query_id", "chunk_id", "rank")


def rerank(candidates: DataFrame, scorer, k: int | None = None) -> DataFrame:
    """Score (query_id, chunk_id, query, code, previous_score, place) with ``scorer(query, code) -> Column``, keep the best ``k``; ties keep their order."""
    once = keep_first(candidates, ["query_id", "chunk_id"], F.col("place"))
    scored = once.withColumn("cross_score", scorer(F.col("query"), F.col("code")))
    out = ranked(scored, ["query_id"], F.round("cross_score", 9).desc(), F.col("place"), name="final_rank")
    return out.where(F.col("final_rank") <= k) if k else out
