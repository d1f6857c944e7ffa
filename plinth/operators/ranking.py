"""Ranks, top-k and keep-first, per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: list[str], *order: Column, name: str = "rank") -> DataFrame:
    """A 1-based row number within ``by``."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def top_k(df: DataFrame, k: int, by: list[str], *order: Column, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark prunes to k in every task before the shuffle."""
    if k <= 0:
        raise ValueError("k must be positive")
    return ranked(df, by, *order, name=name).where(F.col(name) <= k)


def keep_first(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the order given."""
    return top_k(df, 1, by, *order, name="_first").drop("_first")
