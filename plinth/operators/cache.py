"""Similarity cache with a lexical gate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plinth.functions.text import category_bits, content_words, named_terms
from plinth.functions.vectors import unit
from plinth.operators.ranking import keep_first
from plinth.operators.tables import upsert
from plinth.schemas import KEYS

#: Questions and characters of questions that are broadcast at once, about; more of them go in slices.
QUESTION_SLICE, SLICE_CHARS = 8192, 64_000_000
#: Pairs of an entry and a question that a worker scores at once.
PAIRS = 2_000_000


def lookup(entries: DataFrame, asked: DataFrame, threshold: float = 0.95, lexical: float = 0.5) -> DataFrame:
    """The best cached entry for each question, if one passes both gates.

    ``entries``: repository_id, query, query_embedding, response, retrieved_chunk_ids; ``asked``:
    query_id, repository_id, query, vector.  A question meets the entries of its own repository only.
    Words and named terms are read once from each text.  The questions are broadcast in slices, so the
    entries are scanned and never shuffled; a worker multiplies vectors, and tries the lexical gate
    in the order of similarity until an entry passes.
    """
    held = entries.withColumnRenamed("query", "cached_query")
    features = {"_unit": unit(F.col("query_embedding")), "_words": content_words(F.col("cached_query")), "_named": named_terms(F.col("cached_query"))}
    held = held.where(F.col("repository_id").isNotNull() & F.forall("query_embedding", lambda x: x.isNotNull())).withColumns(features)
    n, chars = asked.agg(F.count(F.lit(1)), F.sum(F.length("query"))).first()
    slices = max(1, -(-n // QUESTION_SLICE), -(-(chars or 0) // SLICE_CHARS))
    slices = 1 if slices == 1 else 2 * slices
    part = F.pmod(F.xxhash64("query_id"), F.lit(slices))
    out = None
    for i in range(slices):
        found = _lookup(held, asked.where(part == i) if slices > 1 else asked, threshold, lexical)
        out = found if out is None else out.unionByName(found)
    return keep_first(out, ["query_id"], F.round("similarity", 9).desc(), F.col("cached_query"))


def _lookup(held: DataFrame, asked: DataFrame, threshold: float, lexical: float) -> DataFrame:
    """The pairs of a slice of the questions that may be the best: those that no earlier one of the same task beats."""
    features = {"_unit": unit(F.col("vector")), "_words": content_words(F.col("query")), "_named": named_terms(F.col("query"))}
    usable = asked.where(F.col("repository_id").isNotNull() & F.forall("vector", lambda x: x.isNotNull()))
    shared = asked.sparkSession.sparkContext.broadcast(usable.withColumns(features).toArrow().combine_chunks())  # a slice of the questions
    mine, theirs = [c for c in held.columns if c not in features], [c for c in asked.columns if c != "repository_id"]
    schema = StructType([*(held.schema[c] for c in mine), *(asked.schema[c] for c in theirs), StructField("similarity", DoubleType())])
    categories = category_bits()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions = shared.value
        words = _flat(questions["_words"])
        vocabulary = pc.unique(words)
        q_ids, q_at = _codes(words, vocabulary), _offsets(questions["_words"])
        q_named, q_units = np.asarray(questions["_named"]), questions["_unit"].to_pylist()
        groups = _groups(questions["repository_id"], q_units)
        groups = {key: (qs, np.array([q_units[q] for q in qs], dtype=np.float64)) for key, qs in groups.items()}
        least = np.full(len(q_units), -np.inf)
        asks = np.zeros(len(vocabulary) + 1, dtype=bool)  # the words of one question; the last place stands for words of none
        for batch in batches:
            ids, at = _codes(_flat(batch["_words"]), vocabulary), _offsets(batch["_words"])
            named, units, texts = np.asarray(batch["_named"]), batch["_unit"].to_pylist(), batch["cached_query"]
            rows, matches, scores = [], [], []
            for key, own in _groups(batch["repository_id"], units).items():
                if key not in groups:
                    continue
                qs, matrix = groups[key]
                step = max(1, PAIRS // len(qs))
                for own_rows in (own[i : i + step] for i in range(0, len(own), step)):
                    exact = np.array([units[r] for r in own_rows], dtype=np.float64) @ matrix.T
                    rounded = np.where(np.isnan(exact), np.inf, np.round(exact, 9))  # NaN counts as the largest number
                    for j, q in enumerate(qs):
                        near = np.flatnonzero((rounded[:, j] >= least[q]) & ~(exact[:, j] < threshold))
                        for bits in categories:
                            if (mask := q_named[q] & bits) and len(near):
                                other = named[own_rows[near]] & bits
                                near = near[(other == 0) | (other & mask != 0)]
                        if not len(near):
                            continue
                        asks[q_ids[q_at[q] : q_at[q + 1]]] = True
                        size, won = q_at[q + 1] - q_at[q], None
                        for i in near[np.argsort(-rounded[near, j], kind="stable")]:
                            if won is not None and rounded[i, j] < rounded[won, j]:
                                break
                            r = own_rows[i]
                            common = int(asks[ids[at[r] : at[r + 1]]].sum())
                            union = size + at[r + 1] - at[r] - common
                            if (common / union if union else 0.0) >= lexical and (won is None or _before(texts[int(r)].as_py(), texts[int(own_rows[won])].as_py())):
                                won = i
                        asks[q_ids[q_at[q] : q_at[q + 1]]] = False
                        if won is not None:
                            least[q] = rounded[won, j]
                            rows.append(own_rows[won])
                            matches.append(q)
                            scores.append(exact[won, j])
            if rows:
                left, right = batch.select(mine).take(pa.array(rows)), questions.select(theirs).take(pa.array(matches)).combine_chunks()
                columns = [*left.columns, *(c.combine_chunks() for c in right.columns), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return held.mapInArrow(best, schema)


def _flat(lists) -> pa.Array:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten()


def _offsets(lists) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists), dtype=np.int64))]).astype(np.int64)


def _codes(words: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """The place of each word in the vocabulary; its length for words that are not in it."""
    return np.asarray(pc.fill_null(pc.index_in(words, value_set=vocabulary.cast(words.type)), len(vocabulary)), dtype=np.int64)


def _groups(repositories, units: list) -> dict:
    """The rows of each repository and length of vectors."""
    out: dict = {}
    for i, (repository, vector) in enumerate(zip(repositories.to_pylist(), units, strict=True)):
        out.setdefault((repository, len(vector)), []).append(i)
    return {key: np.array(rows) for key, rows in out.items()}


def _before(a: str | None, b: str | None) -> bool:
    """Whether a text comes before another one, null first."""
    return b is not None and (a is None or a < b)


def store(entries: DataFrame, new: DataFrame) -> DataFrame:
    """The table after new entries: one for each repository and question, the newest."""
    return upsert(entries, new, KEYS["semantic_cache"], F.col("created_at").desc())


def clear(entries: DataFrame, repository_id: str) -> DataFrame:
    return entries.where(F.col("repository_id") != repository_id)
