"""Toxicity by multiple-instance learning.

A document is a bag of sentences (cut after ``.``, ``!``, ``?`` and at line ends) and
is toxic if one of them is.  A sentence has the probability sigmoid(bias + sum of
the weights of its distinct hashed words and word beginnings); the document's is the noisy-or over its
sentences, 1 - prod(1 - p).  Weights are learned from document labels alone, by
gradient descent on the noisy-or likelihood, over a bounded sample (SAMPLE labelled
rows); the trained weights then locate the sentences that offend.

Defined cases: a null or empty text has no sentence that says anything and gets the
noisy-or of one empty sentence; an empty table gives an empty result; without any
usable label every weight is zero and the bias says "not toxic"; repeated rows score
alike; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, crc32_mod, documents, mixed, pieces_of, string_hashes, unique_words, words_of
from .training import labelled_docs, labelled_ids

#: Labelled documents learned from, at most.
SAMPLE = 3000
#: Hashed word features.
BUCKETS = 1 << 18
#: A word must stand in so many documents of the sample to get a weight.
MIN_DOCS = 8
#: Lengths of the word beginnings that are features too; chosen on a part of the rows that may be learned from.
PREFIXES = (4,)
MODULUS, HELD_OUT = 5, 0
BIAS = -6.0
#: A document is rejected from this score on.
THRESHOLD = 0.5
BREAK = "\x1e"


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def sentences(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, feature) pairs without repeats, and the offsets of each text in the sentences (one at least for each text)."""
    text = pc.replace_substring(pc.fill_null(text, ""), "\n", f" {BREAK} ")
    words, offsets = words_of(text)
    distinct, code = unique_words(words)
    ends = np.asarray(pc.fill_null(pc.match_substring_regex(distinct, r"[.!?\x1e][\"')\]]*$"), False))
    plain = pc.ascii_trim(distinct, characters="".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + BREAK)
    # a word, and its beginnings, which inflected forms share
    forms = [plain, *(pc.utf8_slice_codeunits(plain, 0, n) for n in PREFIXES)]
    feature = np.stack([(mixed(string_hashes(x, seed)) & np.uint64(BUCKETS - 1)).astype(np.int64) for seed, x in enumerate(forms)])
    size = np.asarray(pc.utf8_length(plain))
    says = np.stack([size > 0, *(size > n for n in PREFIXES)])
    # A sentence begins at each text's start and after each end.
    begins = np.zeros(len(code) + 1, dtype=bool)
    if len(code):
        begins[1:] = ends[code]
    empty = np.diff(offsets) == 0
    begins[offsets[:-1][~empty]] = True
    number = np.cumsum(begins[: len(code)]) - 1
    per_text = np.add.reduceat(begins[: len(code)], offsets[:-1][~empty]) if (~empty).any() else np.zeros(0, int)
    counts = np.ones(len(empty), dtype=np.int64)
    counts[~empty] = per_text
    starts = np.concatenate([[0], np.cumsum(counts)])
    # Empty texts have a sentence of their own too: move the numbers of later sentences along.
    shift = np.cumsum(empty) if len(empty) else np.zeros(0, int)
    text_of = np.searchsorted(offsets, np.arange(len(code)), side="right") - 1
    number = number + shift[text_of] if len(code) else number
    found = [number[keep] * BUCKETS + f[code[keep]] for f, on in zip(feature, says, strict=True) for keep in [on[code]]]
    pair = np.unique(np.concatenate(found))
    return pair // BUCKETS, pair % BUCKETS, starts


def loss_and_slope(w: np.ndarray, row: np.ndarray, col: np.ndarray, doc_of: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """The noisy-or loss of the bags' labels, averaged over bags, and its gradient; the last weight is the bias."""
    n_docs = len(y)
    z = np.bincount(row, w[col], minlength=len(doc_of)) + w[-1]
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    clean = np.exp(np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n_docs))
    slope = np.where(y == 1, -clean / np.maximum(1 - clean, 1e-6), 1.0)[doc_of] * p
    loss = -np.where(y == 1, np.log(np.maximum(1 - clean, 1e-300)), np.log(np.maximum(clean, 1e-300))).sum() / n_docs
    return float(loss), np.append(np.bincount(col, slope[row], minlength=len(w) - 1), slope.sum()) / n_docs


def train(pair_sentence: np.ndarray, pair_feature: np.ndarray, doc_of: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.25, decay: float = 2e-4) -> Model:
    """Weights that fit the labels ``y`` of bags; ``doc_of`` tells the bag of each sentence."""
    weights, bias = np.zeros(BUCKETS), BIAS
    if not len(y):
        return Model(weights, bias)
    names, col = np.unique(pair_feature, return_inverse=True)
    row = pair_sentence
    w, m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    w[-1] = bias
    for t in range(1, steps + 1):
        _, g = loss_and_slope(w, row, col, doc_of, y)
        g[:-1] += decay * np.sign(w[:-1]) + decay * 0.1 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6) * (1 if t < steps * 2 // 3 else 0.2)
        w[-1] = min(w[-1], -3.0)  # a sentence that says nothing known stays clean
    weights[names] = np.where(np.abs(w[:-1]) < 0.05, 0, w[:-1])
    return Model(weights, float(w[-1]))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled rows that are not held out."""
    chosen = labelled_docs(docs, labelled_ids(labels, "toxic", MODULUS, HELD_OUT, sample))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            sentence, feature, starts = sentences(batch.column("text"))
            for i, (doc_id, y) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("y").to_pylist(), strict=True)):
                a, b = np.searchsorted(sentence, starts[i : i + 2])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id], pa.int64()), pa.array([y], pa.int32()), pa.array([int(starts[i + 1] - starts[i])], pa.int64()), pa.array([(sentence[a:b] - starts[i]).astype(np.int32).tobytes()], pa.binary()), pa.array([feature[a:b].astype(np.int32).tobytes()], pa.binary())],
                    names=["doc_id", "y", "n", "sentence", "feature"],
                )

    pairs, names, doc_of, ys, at = [], [], [], [], 0
    rows = sorted(chosen.mapInArrow(features, "doc_id bigint, y int, n bigint, sentence binary, feature binary").toLocalIterator(), key=lambda r: (r[0], r[3], r[4]))
    in_docs = np.zeros(BUCKETS, dtype=np.int32)
    for *_, feature in rows:
        in_docs[np.unique(np.frombuffer(feature, np.int32))] += 1
    common = in_docs >= min(MIN_DOCS, max(1, len(rows) // 20))
    for i, (_, y, n, sentence, feature) in enumerate(rows):
        found = np.frombuffer(feature, np.int32)
        use = common[found]
        pairs.append(np.frombuffer(sentence, np.int32)[use] + np.int32(at))
        names.append(found[use])
        doc_of.append(np.full(n, i, dtype=np.int32))
        ys.append(y)
        at += n
    del rows
    empty = np.zeros(0, np.int32)
    return train(np.concatenate(pairs or [empty]), np.concatenate(names or [empty]), np.concatenate(doc_of or [empty]), np.array(ys))


def sentence_scores(model: Model, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The probability of each sentence, and the offsets of each text in them."""
    sentence, feature, starts = sentences(text)
    z = np.bincount(sentence, model.weights[feature], minlength=int(starts[-1])) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), starts


def noisy_or(p: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """1 - prod(1 - p) for each text."""
    if len(starts) < 2:
        return np.zeros(0)
    return 1 - np.exp(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), starts[:-1]))


SCORE_SCHEMA = "doc_id bigint, score double, n_sentences bigint, worst_sentence bigint, n_offending bigint"


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """For each row: the score, and where it comes from (sentences counted from 0; offending: with a probability of one half at least)."""
    shared = spark.sparkContext.broadcast(model)  # BUCKETS weights

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            p, starts = sentence_scores(shared.value, batch.column("text"))
            worst = [int(np.argmax(p[a:b])) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            bad = np.add.reduceat(p >= 0.5, starts[:-1], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(noisy_or(p, starts)), pa.array(np.diff(starts)), pa.array(worst, pa.int64()), pa.array(bad)], names=["doc_id", "score", "n_sentences", "worst_sentence", "n_offending"]
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(make, SCORE_SCHEMA)


def reject_toxic(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, as they are."""
    shared = spark.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            yield batch.filter(pa.array(noisy_or(*sentence_scores(shared.value, batch.column("text"))) < threshold))

    Scratch(spark, "toxicity")
    return docs.mapInArrow(keep, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    Scratch(spark, "toxicity")
    model = fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = (crc32_mod("doc_id", MODULUS) == HELD_OUT).alias("held_out")
    return score(spark, docs, model).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "worst_sentence", "n_offending")
