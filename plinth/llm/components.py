"""Connected components by alternating large-star and small-star, all in DataFrames.

Large-star joins every larger neighbour of a node to the least node around it;
small-star joins a node and its smaller neighbours to the least of them.  Alternated
until the edges stay the same, they end in stars whose centres are the least node of
each component.  Minima are pre-aggregated before the shuffle, and the join that hands
them back to the edges of a node is one whose skewed partitions Spark splits, so a node
with very many edges is no task of its own.  Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(scratch: Scratch, pairs: DataFrame) -> DataFrame:
    """(v, m) for each (u, v): m is the least of u and its v.

    The minima are kept as a table: only a join of two plain exchanges can be split.
    """
    least = scratch.keep(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return pairs.join(least.hint("merge"), "u")


def large_star(scratch: Scratch, edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _star(scratch, both).where("v > u").select(F.col("v").alias("b"), F.col("m").alias("a"))


def small_star(scratch: Scratch, edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    starred = _star(scratch, down)
    own = starred.select(F.col("u").alias("b"), F.col("m").alias("a"))
    return own.unionByName(starred.select(F.col("v").alias("b"), F.col("m").alias("a"))).where("a <> b")


def components(scratch: Scratch, edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: bigint) but the roots themselves; a root is the least node of its component."""

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    clean = edges.where("a <> b").select(F.least("a", "b").cast("bigint").alias("a"), F.greatest("a", "b").cast("bigint").alias("b")).distinct()
    current = scratch.write_small(clean, f"{name}-0")
    before, turn = mark(current), 0
    while before[0]:
        turn += 1
        large = scratch.keep(large_star(scratch, current).distinct())
        following = scratch.write_small(small_star(scratch, large).distinct(), f"{name}-{turn}")
        after = mark(following)
        scratch.drop(f"{name}-{turn - 1}")
        current = following
        if after == before:
            break
        before = after
    return current.select(F.col("b").alias("node"), F.col("a").alias("root"))
