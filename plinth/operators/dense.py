"""Exact dense search: cosine of unit vectors, best k per query, ties by id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plinth.functions.vectors import unit
from plinth.operators.blocks import Best, block_rows
from plinth.operators.ranking import top_k

#: Query vectors that are broadcast at once, about; more of them go in slices.
QUERY_SLICE = 4096


def build_index(vectors: DataFrame, id_col: str, vector_col: str, width: int | None = None) -> DataFrame:
    """(id, unit): the stored index is this table.  With ``width``, other lengths are an error."""
    v = F.col(vector_col)
    if width is not None:
        v = F.when(F.size(v) == width, v).otherwise(F.raise_error(F.concat(F.lit("vector of length "), F.size(v), F.lit(f" instead of {width}"))))
    return vectors.select(F.col(id_col).alias("id"), unit(v).alias("unit"))


def _search_slice(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): the best of every task's vectors for each query."""
    asked = queries.select("query_id", unit(F.col("vector")).alias("q")).toArrow().combine_chunks()  # a slice of the queries
    names = asked.column("query_id").combine_chunks()
    matrix = np.asarray(asked.column("q").combine_chunks().flatten(), dtype=np.float64).reshape(len(names), -1) if len(names) else np.zeros((0, 0))
    shared = queries.sparkSession.sparkContext.broadcast((names, matrix))
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("id", index.schema["id"].dataType), StructField("score", DoubleType())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        kept = Best(len(names), k)
        for batch in batches:
            if not len(names):
                continue
            vectors, ids = batch.column("unit"), batch.column("id")
            for at in range(0, batch.num_rows, step := block_rows(len(names))):
                part = vectors.slice(at, step)
                kept.add(np.asarray(part.flatten(), dtype=np.float64).reshape(len(part), -1) @ matrix.T, ids.slice(at, step))
        if (found := kept.reduce()) is not None:
            found = found.combine_chunks()
            yield pa.RecordBatch.from_arrays([names.take(found["query"].combine_chunks()), found["id"].combine_chunks(), found["score"].combine_chunks()], names=["query_id", "id", "score"])

    return index.select("id", "unit").mapInArrow(best, schema)


def search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The nearest ``k`` of each query (query_id, vector): (query_id, id, score, rank).

    The queries are broadcast in slices, and multiplied with blocks of vectors; so the vectors
    are scanned once for each slice and never shuffled, and k rows of a task go on for each query.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    n = queries.count()
    slices = 1 if n <= QUERY_SLICE else 2 * -(-n // QUERY_SLICE)
    part = F.pmod(F.xxhash64("query_id", "vector"), F.lit(slices))  # rows that share an id may lie in several slices
    out = None
    for i in range(slices):
        found = _search_slice(index, queries.where(part == i) if slices > 1 else queries, k)
        out = found if out is None else out.unionByName(found)
    return top_k(out, k, ["query_id"], F.round("score", 9).desc(), F.col("id"))
