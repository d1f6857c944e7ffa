"""Quality classifier: supervised subword embeddings.

Every word, every character n-gram of the word between ``<`` and ``>``, and every pair of
neighbouring words is hashed to a bucket with a learned vector.  A pair's bucket comes from
the difference of its words' hashes, so all pairs of equal words share one (what repetition
says about a text is then learned from all words together).  A document is the average of the
vectors of all its features, and a softmax layer over it gives the probabilities of both labels.
The features were chosen on a part of the rows that may be learned from.
Vectors and layer are trained together by stochastic gradient descent in numpy, on a
bounded sample (SAMPLE labelled rows).

A trained model is applied as one number for each bucket: the difference of the two
outputs is linear in the average, so a bucket's vector counts only by its product with
the difference of the two output rows.

Defined cases: a null or empty text has the average zero and gets the score of the
output bias alone; an empty table gives an empty result; without usable labels all
scores are one half; repeated rows score alike; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, byte_view, crc32_mod, documents, mixed, pieces_of, string_hashes, unique_words, words_of
from .training import labelled_docs, labelled_ids

#: Labelled documents learned from, at most.
SAMPLE = 3000
BUCKETS = 1 << 16
WIDTH = 12
#: Lengths in bytes of the character n-grams.
GRAMS = (3, 4)
EPOCHS = 4
RATE = 0.6
MODULUS, HELD_OUT = 3, 1


def pair_buckets(hashes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The bucket of each word with the one before it (the first: with itself, to be left out)."""
    own = hashes[code]
    return (mixed(own - np.concatenate([own[:1], own[:-1]])) & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """``value``: the part of each bucket in the difference of the outputs; ``bias``: the difference of their biases."""

    value: np.ndarray
    bias: float


def features(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words and their n-grams, flat, and the word that each belongs to."""
    n = len(distinct)
    mask = np.uint64(BUCKETS - 1)
    buckets = [(mixed(string_hashes(distinct)) & mask).astype(np.int64)]
    owners = [np.arange(n)]
    framed = pc.binary_join_element_wise("<", distinct, ">", "") if n else distinct
    flat, offsets = byte_view(framed.combine_chunks() if isinstance(framed, pa.ChunkedArray) else framed)
    word = np.repeat(np.arange(n), np.diff(offsets)) if n else np.zeros(0, np.int64)
    wide = flat.astype(np.uint64) + np.uint64(1)
    for size in GRAMS:
        if len(wide) < size:
            continue
        span = len(wide) - size + 1
        code = np.full(span, size, dtype=np.uint64)
        for j in range(size):
            code = code * np.uint64(257) + wide[j : j + span]
        inside = word[:span] == word[size - 1 :]
        buckets.append((mixed(code[inside]) & mask).astype(np.int64))
        owners.append(word[:span][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def step(vectors: np.ndarray, out: np.ndarray, bias: np.ndarray, buckets: np.ndarray, share: np.ndarray, y: int, rate: float) -> None:
    """One document's step down the gradient of the softmax loss, in place."""
    mean = share @ vectors[buckets] if len(buckets) else np.zeros(vectors.shape[1], vectors.dtype)
    z = out @ mean + bias
    p = np.exp(z - z.max())
    p /= p.sum()
    p[y] -= 1
    back = p @ out
    out -= rate * np.outer(p, mean)
    bias -= 0.1 * rate * p
    if len(buckets):
        # shares of a long text are tiny: a word learns by its share of the text, on the scale of one feature
        vectors[buckets] -= rate * (share * min(200.0, float(len(buckets))))[:, None] * back


def train(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 7) -> Model:
    """SGD over documents, each given as distinct buckets and their shares of the average."""
    rng = np.random.default_rng(seed)
    vectors = (rng.random((BUCKETS, WIDTH), dtype=np.float32) - 0.5) / WIDTH
    out, bias = np.zeros((2, WIDTH), dtype=np.float32), np.zeros(2, dtype=np.float32)
    steps, total = 0, max(1, EPOCHS * len(docs))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            step(vectors, out, bias, *docs[i], int(y[i]), RATE * (1 - steps / total))
            steps += 1
    return Model((vectors @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0]))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled rows that are not held out."""
    chosen = labelled_docs(docs, labelled_ids(labels, "quality", MODULUS, HELD_OUT, sample))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            words, offsets = words_of(batch.column("text"), lower=False)
            distinct, code = unique_words(words)
            bucket, owner = features(distinct)
            order = np.argsort(owner, kind="stable")
            bucket = bucket[order]
            per = np.bincount(owner, minlength=len(distinct))
            starts = np.concatenate([[0], np.cumsum(per)])
            pairs = pair_buckets(string_hashes(distinct), code)
            for i, (doc_id, y) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("y").to_pylist(), strict=True)):
                some, times = np.unique(code[offsets[i] : offsets[i + 1]], return_counts=True)
                count = np.zeros(BUCKETS)
                for w, t in zip(some.tolist(), times.tolist(), strict=True):
                    np.add.at(count, bucket[starts[w] : starts[w + 1]], t)
                count += np.bincount(pairs[offsets[i] + 1 : offsets[i + 1]], minlength=BUCKETS)
                at = np.flatnonzero(count)
                share = (count[at] / max(1.0, count.sum())).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([y], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([share.tobytes()], pa.binary())], names=["doc_id", "y", "at", "share"])

    rows = sorted(chosen.mapInArrow(make, "doc_id bigint, y int, at binary, share binary").toLocalIterator(), key=lambda r: (r[0], r[2], r[3]))
    texts = [(np.frombuffer(at, np.uint16), np.frombuffer(share, np.float16).astype(np.float32)) for _, _, at, share in rows]
    return train(texts, np.array([r[1] for r in rows], dtype=np.int64))


def margins(model: Model, text: pa.Array) -> np.ndarray:
    """The difference of the two outputs for each text."""
    words, offsets = words_of(text, lower=False)
    distinct, code = unique_words(words)
    bucket, owner = features(distinct)
    value = np.bincount(owner, model.value[bucket], minlength=len(distinct))
    size = np.bincount(owner, minlength=len(distinct))
    sums = np.concatenate([[0.0], np.cumsum(value[code])])
    sizes = np.concatenate([[0], np.cumsum(size[code])])
    pairs = model.value[pair_buckets(string_hashes(distinct), code)]
    pairs[offsets[:-1][np.diff(offsets) > 0]] = 0.0  # a text's first word has none before it
    sums += np.concatenate([[0.0], np.cumsum(pairs)])
    n = sizes[offsets[1:]] - sizes[offsets[:-1]] + np.maximum(np.diff(offsets) - 1, 0)
    return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(n, 1) + model.bias


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the probability of label 1 for each row."""
    shared = spark.sparkContext.broadcast(model)  # BUCKETS numbers

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            z = np.clip(margins(shared.value, batch.column("text")), -30, 30)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(make, "doc_id bigint, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    Scratch(spark, "quality")
    model = fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = (crc32_mod("doc_id", MODULUS) == HELD_OUT).alias("held_out")
    return score(spark, docs, model).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
