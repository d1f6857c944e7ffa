"""Choice of labelled rows for the classifiers: a bounded sample, the same at every size and partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod


def labelled_ids(labels: DataFrame, label: str, modulus: int, held_out: int, limit: int) -> DataFrame:
    """At most ``limit`` (doc_id, y) of rows that may be learned from, in the order of a hash of the id.

    Rows whose crc32 of the id modulo ``modulus`` is ``held_out`` are left out, as are null ids and
    labels; of several labels for one id the largest counts.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc32_mod("doc_id", modulus) != held_out))
    one = usable.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def labelled_docs(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts and labels of the chosen ids; ``ids`` is broadcast, being bounded by the sample's limit."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y")
