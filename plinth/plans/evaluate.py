"""Evaluation runs: five configurations over a set of questions, and reports as JSON."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.operators.metrics import mean, precision_at_k
from plinth.operators.ranking import keep_first
from plinth.plans.pipeline import Engine

# The stages of each configuration, in the order of the report.
CONFIGURATIONS = {
    "Dense Retrieval Only": {"use_hybrid": False, "use_graph": False, "use_rerank": False, "use_parents": False},
    "Dense + BM25": {"use_hybrid": True, "use_graph": False, "use_rerank": False, "use_parents": False},
    "Dense + BM25 + Graph Expansion": {"use_hybrid": True, "use_graph": True, "use_rerank": False, "use_parents": False},
    "Dense + BM25 + Graph + Cross Encoder": {"use_hybrid": True, "use_graph": True, "use_rerank": True, "use_parents": False},
    "Full Pipeline": {"use_hybrid": True, "use_graph": True, "use_rerank": True, "use_parents": True},
}
TOP, RELEVANT = 5, 4


def by_expected_files(cases: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Grades 5 for chunks of an expected file, else 1; stands in for a judge."""

    def grade(found: DataFrame) -> DataFrame:
        return found.join(cases.select("query_id", "expected_source_files"), "query_id").withColumn("grade", F.when(F.array_contains("expected_source_files", F.col("file_path")), 5).otherwise(1))

    return grade


def ablation(engine: Engine, rid: str, cases: DataFrame, judge: Callable[[DataFrame], DataFrame], faithful: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(config_name, precision_at_5, mean_grade, faithfulness, latency_ms) of each configuration over ``cases`` (query_id, query, ...).

    ``faithful(answer, context)`` scores answers; without it that mean is 0.
    """
    rows = []
    questions = cases.select("query_id", "query")
    n = max(1, questions.count())
    for name, stages in CONFIGURATIONS.items():
        run = replace(engine, settings=replace(engine.settings, use_cache=False, **stages))
        began = time.perf_counter()
        found = run.search(rid, questions).cache()
        answers = run.ask(rid, questions)
        quality = answers.agg(mean(faithful(F.col("answer"), F.col("context")) if faithful else F.lit(0.0)).alias("f")).first().f
        took = (time.perf_counter() - began) * 1000 / n
        means = precision_at_k(judge(found), TOP, RELEVANT).agg(mean(F.col("precision")).alias("p"), mean(F.col("mean_grade")).alias("g")).first()
        found.unpersist()
        rows.append((name, float(means.p), float(means.g), float(quality), took))
    return engine.spark.createDataFrame(rows, "config_name string, precision_at_5 double, mean_grade double, faithfulness double, latency_ms double")  # one row for each configuration


def save_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines in one file; reports have a few rows."""
    df.coalesce(1).write.mode("overwrite").json(path)


def load_reports(spark, path: str) -> DataFrame:
    return spark.read.json(path)


def best_row(report: DataFrame, metric: str = "precision_at_5") -> DataFrame:
    return report.select(F.max_by(F.struct(*report.columns), metric).alias("r")).select("r.*")


def append_cases(report: DataFrame, more: DataFrame, key: str = "case_id") -> DataFrame:
    """Case lists of two runs; a case that ran again counts with its newer row."""
    both = report.withColumn("_new", F.lit(0)).unionByName(more.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, [key], F.col("_new").desc()).drop("_new")
