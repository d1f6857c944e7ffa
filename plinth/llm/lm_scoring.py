"""Language-model scores: marginal likelihood over a subword lattice.

A text is a sequence of words and one end.  A word stands for all sequences of vocabulary
pieces that spell it; the probability of a sequence is the product of its pieces', that of
the word the sum over all its segmentations, by a forward recursion in log space.  No piece
crosses a word's bounds, so the text's marginal probability is the product of its words'
and the end's.  Pieces and the end share one distribution, which makes the probabilities of
all texts add up to one at most.

The existing vocabulary's scores say which pieces are likelier.  They are ranks, not
probabilities, so they only start the piece weights (a piece of rank r begins with
1 / (r + 3)); EM_ROUNDS passes of expectation maximisation over the counts of all training
words then make them probabilities of this corpus.

Beside ``score`` comes ``word_score``, in which a word seen in training has an arc of its own:
with N tokens, V words and the absolute discount D = n1 / (n1 + 2 n2) (n1, n2: words seen
once, twice) it weighs (c - D) / N, the marginal over pieces D V / N, and the end its own
relative frequency.

The counts of all words stay a table.  The most frequent words (HEAD at most) are
broadcast and take care of most tokens on the map side; all other words of a text are
joined with the table, pre-aggregated by text.

Defined cases: null and empty texts have the end alone; with no training text the base
is log10(1) for each token and all pieces and the end have equal weight; repeated rows
score alike; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, Scratch, crc32_mod, documents, gathered, unique_words, words_of
from .lattice import MARK, PieceIndex, Vocabulary, arc_slots, arcs_from, load_vocabulary, same_length
from .sentencepiece_coding import VOCABULARY

MODULUS, HELD_OUT = 7, 2
#: Words that are broadcast at most.
HEAD = 1 << 17
#: Bytes of words whose lattices are summed at once.
WORD_BYTES = 1 << 18
#: Passes of expectation maximisation over the counted words.
EM_ROUNDS = 3
#: What every piece is given beside its expected count.
SMOOTHING = 0.01
LN10 = math.log(10.0)
#: Stands for the end of a text among the words, of which none holds a space.
END = " "


@dataclass(frozen=True)
class Pieces:
    """ln probabilities: ``logs`` by id, ``table`` by piece (and 1 for what is only the beginning of one), ``bytes_`` of the byte pieces."""

    table: dict[str, float]
    bytes_: list[float]
    logs: np.ndarray
    index: PieceIndex


def pieces(vocabulary: Vocabulary, weights: np.ndarray, end: float) -> Pieces:
    """``end``: the weight of the end, which shares one distribution with the pieces."""
    logs = np.log(weights / (weights.sum() + end))
    table = {k: 1.0 for k, v in vocabulary.table.items() if v > 0}
    table.update((p, float(logs[i])) for p, i in vocabulary.ids.items())
    return Pieces(table, [float(logs[i]) for i in vocabulary.byte_ids], logs, vocabulary.index())


def first_weights(vocabulary: Vocabulary) -> np.ndarray:
    """1 / (rank + 3) for each piece, by falling scores; byte pieces and unused ids come last."""
    order = sorted(vocabulary.ids.values(), key=lambda i: (-vocabulary.scores[i], i))
    weights = np.full(len(vocabulary.scores), 1.0 / (len(order) + 3))
    weights[order] = 1.0 / (np.arange(len(order)) + 3)
    return weights


def marginal(unit: str, p: Pieces) -> float:
    """ln of the summed probability of all segmentations: the forward recursion in log space."""
    n = len(unit)
    total = [-math.inf] * (n + 1)
    total[0] = 0.0
    get, exp, log1p = p.table.get, math.exp, math.log1p
    for start in range(n):
        base = total[start]
        alone = True
        for stop in range(start + 1, n + 1):
            score = get(unit[start:stop])
            if score is None:
                break
            if score > 0:
                continue
            if stop == start + 1:
                alone = False
            x, y = base + score, total[stop]
            total[stop] = x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))
        if alone:
            x, y = base + sum(p.bytes_[b] for b in unit[start].encode("utf-8", "surrogatepass")), total[start + 1]
            total[start + 1] = x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))
    return total[n]


def marginals(units: list[str], p: Pieces) -> np.ndarray:
    """:func:`marginal` of many units at once."""
    out = np.zeros(len(units))
    index = p.index
    logs = np.where(index.ids >= 0, p.logs[index.ids], -np.inf)
    for own, chars in same_length(units):
        if chars is None:
            out[own] = [marginal(units[i], p) for i in own.tolist()]
            continue
        n = chars.shape[1]
        slots = arc_slots(chars, index)
        arcs = np.where(slots >= 0, logs[slots], -np.inf)
        for pos, row in zip(*np.nonzero(slots[0] < 0), strict=True):
            arcs[0, pos, row] = sum(p.bytes_[x] for x in chr(chars[row, pos]).encode("utf-8", "surrogatepass"))
        total = np.full((n + 1, len(own)), -np.inf)
        total[0] = 0.0
        for stop in range(1, n + 1):
            for size in range(1, min(stop, len(arcs)) + 1):
                total[stop] = np.logaddexp(total[stop], total[stop - size] + arcs[size - 1, stop - size])
        out[own] = total[n]
    return out


def expected(units: list[str], times: np.ndarray, vocabulary: Vocabulary, index: PieceIndex, weights: np.ndarray) -> np.ndarray:
    """Expected piece counts of ``times`` occurrences of each unit: forward and backward sums over its lattice."""
    found = np.zeros(len(weights))
    of_slot = np.where(index.ids >= 0, weights[index.ids], 0.0)
    for own, chars in same_length(units):
        if chars is None:
            for i in own.tolist():
                _expected_long(units[i], float(times[i]), vocabulary, weights, found)
            continue
        n = chars.shape[1]
        slots = arc_slots(chars, index)
        arcs = np.where(slots >= 0, of_slot[slots], 0.0)
        lone = list(zip(*(x.tolist() for x in np.nonzero(slots[0] < 0)), strict=True))
        for pos, row in lone:
            arcs[0, pos, row] = math.prod(weights[vocabulary.byte_ids[x]] for x in chr(chars[row, pos]).encode("utf-8", "surrogatepass"))
        forward, backward = np.zeros((n + 1, len(own))), np.zeros((n + 1, len(own)))
        forward[0] = 1.0
        for stop in range(1, n + 1):
            for size in range(1, min(stop, len(arcs)) + 1):
                forward[stop] += forward[stop - size] * arcs[size - 1, stop - size]
        safe = forward[n] > 1e-250
        for i in own[~safe].tolist():
            _expected_long(units[i], float(times[i]), vocabulary, weights, found)
        backward[n] = np.where(safe, times[own] / np.where(safe, forward[n], 1.0), 0.0)
        for start in range(n - 1, -1, -1):
            for size in range(1, min(n - start, len(arcs)) + 1):
                share = arcs[size - 1, start] * backward[start + size]
                backward[start] += share
                slot = slots[size - 1, start]
                on = slot >= 0
                found += np.bincount(index.ids[slot[on]], (share * forward[start])[on], minlength=len(found))
        for pos, row in lone:
            for x in chr(chars[row, pos]).encode("utf-8", "surrogatepass"):
                found[vocabulary.byte_ids[x]] += forward[pos, row] * arcs[0, pos, row] * backward[pos + 1, row]
    return found


def _expected_long(unit: str, times: float, vocabulary: Vocabulary, weights: np.ndarray, found: np.ndarray) -> None:
    """:func:`expected` of one unit in log space, for long units and those whose probabilities leave the range of doubles."""
    n = len(unit)
    arcs = [(start, stop, ids, sum(math.log(weights[i]) for i in ids)) for start in range(n) for stop, ids in arcs_from(unit, start, vocabulary)]
    forward, backward = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    forward[0] = backward[n] = 0.0
    for start, stop, _, w in arcs:
        forward[stop] = float(np.logaddexp(forward[stop], forward[start] + w))
    for start, stop, _, w in reversed(arcs):
        backward[start] = float(np.logaddexp(backward[start], backward[stop] + w))
    for start, stop, ids, w in arcs:
        share = times * math.exp(min(0.0, forward[start] + w + backward[stop] - forward[n]))
        for i in ids:
            found[i] += share


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n: occurrences in all texts, pre-aggregated in each task; END counts texts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            tokens, _ = words_of(batch.column("text"))
            distinct, code = unique_words(tokens)
            n = np.append(np.bincount(code, minlength=len(distinct)), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([distinct, pa.array([END])]), pa.array(n.astype(np.int64))], names=["word", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(make, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def fit_pieces(counts: DataFrame, vocabulary: Vocabulary, ends: int) -> np.ndarray:
    """Piece weights after EM_ROUNDS passes of expectation maximisation over all counted words."""
    weights = first_weights(vocabulary)
    used = np.zeros(len(weights), dtype=bool)
    used[[*vocabulary.ids.values(), *vocabulary.byte_ids]] = True
    index = vocabulary.index()
    for turn in range(EM_ROUNDS):
        share = weights / (weights.sum() + (ends if turn else 0))  # the weights to start with are not on the scale of counts
        shared = counts.sparkSession.sparkContext.broadcast((vocabulary, index, share))  # fixed size: the vocabulary

        def make(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, index, weights = shared.value
            found = np.zeros(len(weights))
            for batch in gathered(batches, "word", WORD_BYTES):
                found += expected([MARK + x for x in batch.column("word").to_pylist()], np.asarray(batch.column("n"), dtype=np.float64), own, index, weights)
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], names=["piece", "n"])

        weights = np.full(len(weights), SMOOTHING)
        for piece, n in counts.mapInArrow(make, "piece int, n double").groupBy("piece").agg(F.sum(F.col("n").cast("decimal(38,9)")).cast("double").alias("n")).collect():  # a row for each piece
            weights[piece] += n
        weights = np.where(used, weights, 1e-300)
        shared.destroy()
    return weights


def score_documents(spark: SparkSession, docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, word_score for each row of ``docs``."""
    scratch = Scratch(spark, "lm-scoring")
    context = spark.sparkContext
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), (crc32_mod("doc_id", MODULUS) == HELD_OUT).alias("held_out"))
    every = scratch.keep(word_counts(docs.where(~F.col("held_out"))))
    counts = every.where(F.col("word") != END)
    once, twice, total, known, ends = every.agg(
        F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2), F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("n"))), F.lit(0))
    ).first()
    floor = math.log10(total + known + 1)
    discount = once / (once + 2 * twice) if once and twice else 0.5
    # What the discount of the words (not of the end) leaves to the pieces; all of it where nothing was counted.
    rest = discount * (known - (ends > 0)) / total if total else 1.0
    ln_rest = math.log(rest) if rest else -math.inf

    vocabulary = load_vocabulary(path)
    weights = fit_pieces(counts, vocabulary, ends)
    shared = context.broadcast(pieces(vocabulary, weights, ends + SMOOTHING))  # fixed size: the vocabulary
    of_end = {
        "base": math.log10(ends + 1) - floor,
        "piece": math.log10((ends + SMOOTHING) / (weights.sum() + ends + SMOOTHING)),
        "word": math.log10(ends / total) if ends else 0.0,
    }

    def with_marginals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in gathered(batches, "word", WORD_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(marginals([MARK + w for w in batch.column("word").to_pylist()], p))], names=["word", "c", "ln_pieces"])

    words = scratch.keep(counts.mapInArrow(with_marginals, "word string, c bigint, ln_pieces double"))
    # The least power of two that at most HEAD words reach.
    sizes = dict(words.groupBy(F.floor(F.log2("c")).cast("int").alias("e")).agg(F.count(F.lit(1)).alias("n")).collect())
    least, many = 64, 0
    while least and many + sizes.get(least - 1, 0) <= HEAD:
        least -= 1
        many += sizes.get(least, 0)

    def logs(c: np.ndarray, ln_pieces: np.ndarray) -> np.ndarray:
        """log10 of the base, the marginal over pieces and the model with whole words (rows) of words with these counts."""
        with np.errstate(divide="ignore"):
            whole = np.logaddexp(np.log(np.where(c > 0, (c - discount) / max(total, 1), 0.0)), ln_rest + ln_pieces)
        return np.stack([np.log10(c + 1.0) - floor, ln_pieces / LN10, whole / LN10])

    top = words.where(F.col("c") >= (1 << least)).select("word", "c", "ln_pieces").collect() if many else []  # at most HEAD rows
    head = context.broadcast((pa.array([r[0] for r in top], pa.string()), logs(np.array([r[1] for r in top], dtype=np.float64), np.array([r[2] for r in top], dtype=np.float64))))
    sums = list(of_end)
    sum_schema = ", ".join(f"{x} double" for x in sums)

    def by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, of_word = head.value
        for batch in gathered(batches, limit=2 * BATCH_BYTES):
            tokens, offsets = words_of(batch.column("text"))
            distinct, code = unique_words(tokens)
            at = np.asarray(pc.fill_null(pc.index_in(distinct, value_set=frequent), -1), dtype=np.int64) if len(frequent) else np.full(len(distinct), -1)
            in_head = at >= 0
            found = []
            for value in [np.ones(len(frequent)), *of_word]:
                run = np.concatenate([[0.0], np.cumsum(np.where(in_head, value[at], 0.0)[code] if len(frequent) else np.zeros(len(code)))])
                found.append(run[offsets[1:]] - run[offsets[:-1]])
            where = np.flatnonzero(~in_head[code])
            text_of = np.searchsorted(offsets, where, side="right") - 1
            pair, times = np.unique(text_of * max(1, len(distinct)) + code[where], return_counts=True)
            ends_at = np.searchsorted(pair, np.arange(batch.num_rows + 1) * max(1, len(distinct)))
            tail = pa.StructArray.from_arrays([distinct.take(pa.array(pair % max(1, len(distinct)))), pa.array(times, pa.int64())], names=["word", "n"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(offsets) + 1), pa.array(np.rint(found[0]).astype(np.int64)), *(pa.array(x) for x in found[1:]), pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), tail)],
                names=["doc_id", "held_out", "n_tokens", "known", *sums, "tail"],
            )

    rows = docs.mapInArrow(by_text, f"doc_id bigint, held_out boolean, n_tokens bigint, known bigint, {sum_schema}, tail array<struct<word:string,n:bigint>>")
    rows = scratch.write(rows.withColumn("row_id", F.monotonically_increasing_id()), "rows")

    def of_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in gathered(batches, "word", WORD_BYTES):
            c = np.asarray(pc.fill_null(batch.column("c"), 0), dtype=np.float64)
            ln = np.array(pc.fill_null(batch.column("ln_pieces"), 0.0), dtype=np.float64)
            new = np.flatnonzero(c == 0)
            names, code = unique_words(batch.column("word").take(pa.array(new)))
            ln[new] = marginals([MARK + w for w in names.to_pylist()], p)[code] if len(new) else 0.0
            times = np.asarray(batch.column("n"), dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(((c > 0) * times).astype(np.int64)), *(pa.array(x) for x in logs(c, ln) * times)], names=["row_id", "known", *sums])

    tail = rows.select("row_id", F.inline("tail"))
    # A word that very many texts hold is one row of the right side; the left side is split.
    scored = tail.join(words.hint("merge"), "word", "left").select("row_id", "word", "n", "c", "ln_pieces").mapInArrow(of_rest, f"row_id bigint, known bigint, {sum_schema}")
    more = scored.groupBy("row_id").agg(*(F.sum(x).alias(f"{x}_more") for x in ("known", *sums)))
    out = rows.drop("tail").join(more, "row_id", "left")
    both = lambda x: F.col(x) + F.coalesce(F.col(f"{x}_more"), F.lit(0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (both("known") + (1 if ends else 0)).cast("bigint").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (both("base") + F.lit(of_end["base"])).alias("base_score"),
        (both("piece") + F.lit(float(of_end["piece"]))).alias("score"),
        (both("word") + F.lit(of_end["word"])).alias("word_score"),
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark, documents(spark, sf_dir))
