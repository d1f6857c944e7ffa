"""Rates and means; every mean of nothing is 0 unless stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.operators.ranking import top_k


def mean(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def rate(hit: Column, of: Column) -> Column:
    """Share of ``of`` that is also ``hit``."""
    n = F.count_if(of)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.count_if(of & hit) / n)


def precision_at_k(judged: DataFrame, k: int, threshold: int, by: str = "query_id") -> DataFrame:
    """Share of relevant rows among the first k that there are; also their mean grade."""
    first = top_k(judged, k, [by], F.col("rank"), name="_r")
    return first.groupBy(by).agg(mean((F.col("grade") >= threshold).cast("double")).alias("precision"), mean(F.col("grade")).alias("mean_grade"), F.count(F.lit(1)).alias("considered"))


def mean_of_means(per_query: DataFrame) -> DataFrame:
    return per_query.agg(mean(F.col("precision")).alias("mean_precision"), mean(F.col("mean_grade")).alias("mean_grade"), F.count(F.lit(1)).alias("n_queries"))


def review_rates(cases: DataFrame) -> DataFrame:
    """catch and false-positive rates, mean calls, tokens and rounds of (is_buggy, flagged, llm_calls, total_tokens, rounds_used); rounds: null if there are none."""
    return cases.agg(
        rate(F.col("flagged"), F.col("is_buggy")).alias("catch_rate"),
        rate(F.col("flagged"), ~F.col("is_buggy")).alias("false_positive_rate"),
        mean(F.col("llm_calls")).alias("avg_llm_calls"),
        mean(F.col("total_tokens")).alias("avg_tokens"),
        F.avg("rounds_used").alias("avg_rounds"),
        F.count_if("is_buggy").alias("n_buggy"),
        F.count_if(~F.col("is_buggy")).alias("n_clean"),
    )


def claim_flip_rate(claims: DataFrame) -> DataFrame:
    return claims.agg(mean(F.col("refuted").cast("double")).alias("flip_rate"), F.count(F.lit(1)).alias("n_claims"), F.count_if("refuted").alias("n_refuted"))


def merged_mean(old_mean: Column, n: Column, x: Column) -> Column:
    """The mean after one more value."""
    return (old_mean * n + x) / (n + 1)


def merged_rate(old_rate: Column, n: Column, hit: Column) -> Column:
    """The rate after one more case; the former count is the rate times n, rounded."""
    return (F.round(old_rate * n) + hit.cast("int")) / (n + 1)


def ablation_means(rows: DataFrame, metrics: list[str]) -> DataFrame:
    return rows.groupBy("config_name").agg(*(mean(F.col(m)).alias(m) for m in metrics))


def best_config(means: DataFrame, metric: str, order: str = "config_name") -> DataFrame:
    """The configuration with the largest value; the first of equal ones."""
    return means.orderBy(F.col(metric).desc(), F.col(order)).limit(1)


# The metrics of a report on answers.
ANSWER_METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")


def answer_report(scored: DataFrame) -> DataFrame:
    """The mean of each of ANSWER_METRICS over the cases that have it, and the number of cases."""
    return scored.agg(*(mean(F.col(m)).alias(m) for m in ANSWER_METRICS), F.count(F.lit(1)).alias("n_cases"))


def usage(events: DataFrame) -> DataFrame:
    """Calls and tokens of each case."""
    return events.groupBy("case_id").agg(F.sum("tokens").alias("total_tokens"), F.count(F.lit(1)).alias("llm_calls"))


def session_stats(asks: DataFrame) -> DataFrame:
    """Cache hit rate, and mean latency over misses."""
    return asks.agg(mean(F.col("cache_hit").cast("double")).alias("hit_rate"), mean(F.when(~F.col("cache_hit"), F.col("latency"))).alias("mean_miss_latency"))
