"""SentencePiece encoding and decoding with N-best segmentation.

The score of a segmentation is the sum of the vocabulary's scores of its pieces.  Over
the lattice of a unit a forward Viterbi pass gives the best score of every prefix; these
are exact heuristics for an A-star search that runs backward from the end, so complete
segmentations leave its agenda in the order of their scores and the first N are the N
best.  A text's N best are merged from its units': only the N - 1 units with the smallest
loss from best to second best can differ from their best in any of them.

Ties: of segmentations with equal scores, the one whose last pieces are longer comes first.

Defined cases: null and empty texts have no pieces and one segmentation with score 0; a
character without a piece is written as bytes; decoding gives back the text exactly; an
empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, byte_view, documents, pieces_of, unique_words
from .lattice import MARK, MISSING, UNITS, PieceIndex, Vocabulary, arc_slots, arcs_from, load_vocabulary, prepare, same_length, utf8_length

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
#: Units whose N best a worker keeps.
CACHE_UNITS = 30_000
NEVER = float("-inf")


def _forward(unit: str, vocabulary: Vocabulary) -> tuple[list[float], list[list[tuple[int, float, tuple[int, ...]]]]]:
    """The best score of each prefix, and for each position the arcs (start, score, ids) that end there."""
    n = len(unit)
    best = [NEVER] * (n + 1)
    best[0] = 0.0
    into: list[list] = [[] for _ in range(n + 1)]
    scores = vocabulary.scores
    for start in range(n):
        base = best[start]
        for stop, ids in arcs_from(unit, start, vocabulary):
            score = scores[ids[0]] if len(ids) == 1 else sum(scores[i] for i in ids)
            into[stop].append((start, score, ids))
            if base + score > best[stop]:
                best[stop] = base + score
    return best, into


def n_best(unit: str, vocabulary: Vocabulary, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` best segmentations (score, ids) of a unit, best first: backward A-star with exact heuristics."""
    best, into = _forward(unit, vocabulary)
    agenda = [(-best[-1], len(unit), 0, 0.0, None)]
    order, found = 1, []
    while agenda and len(found) < n:
        _, at, _, suffix, pieces = heapq.heappop(agenda)
        if at == 0:
            ids: list[int] = []
            while pieces is not None:
                ids.extend(pieces[0])
                pieces = pieces[1]
            found.append((suffix, tuple(ids)))
            continue
        for start, score, ids in into[at]:
            heapq.heappush(agenda, (-(best[start] + score + suffix), start, order, score + suffix, (ids, pieces)))
            order += 1
    return found


def best_and_loss(unit: str, vocabulary: Vocabulary) -> tuple[tuple[int, ...], float, float]:
    """The best segmentation, its score, and what the second best loses against it (infinite if there is none).

    One forward pass that keeps the two best scores of every prefix.
    """
    n = len(unit)
    first, second, back = [0.0] + [NEVER] * n, [NEVER] * (n + 1), [0] * (n + 1)
    get = vocabulary.table.get
    for start in range(n):
        one, two = first[start], second[start]
        alone = True
        for stop in range(start + 1, n + 1):
            score = get(unit[start:stop], MISSING)
            if score > 0:
                if score == MISSING:
                    break
                continue
            if stop == start + 1:
                alone = False
            x = one + score
            if x > first[stop]:
                second[stop] = max(first[stop], two + score)
                first[stop], back[stop] = x, start
            elif x > second[stop]:
                second[stop] = x
        if alone:
            stop, score = start + 1, vocabulary.byte_score * len(unit[start].encode("utf-8", "surrogatepass"))
            x = one + score
            if x > first[stop]:
                second[stop] = max(first[stop], two + score)
                first[stop], back[stop] = x, start
            elif x > second[stop]:
                second[stop] = x
    ids: list[int] = []
    stop = n
    while stop:
        piece = unit[back[stop] : stop]
        if piece in vocabulary.ids:
            ids.append(vocabulary.ids[piece])
        else:
            ids.extend(vocabulary.byte_ids[x] for x in reversed(piece.encode("utf-8", "surrogatepass")))
        stop = back[stop]
    return tuple(reversed(ids)), first[n], first[n] - second[n]


def segment(units: list[str], index: PieceIndex, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`best_and_loss` of many units at once: flat ids, and for each unit their number, the score and the loss."""
    counts, score, loss = np.zeros(len(units), dtype=np.int64), np.zeros(len(units)), np.zeros(len(units))
    parts: list[np.ndarray | None] = [None] * len(units)
    for own, chars in same_length(units):
        if chars is None:
            for i in own.tolist():
                ids, score[i], loss[i] = best_and_loss(units[i], vocabulary)
                parts[i] = np.array(ids, dtype=np.int32)
                counts[i] = len(ids)
            continue
        ids, number, score[own], loss[own] = _segment_alike(chars, index, vocabulary)
        counts[own] = number
        flat = ids[np.arange(ids.shape[1]) >= ids.shape[1] - number[:, None]]
        for i, part in zip(own.tolist(), np.split(flat, np.cumsum(number)[:-1]), strict=True):
            parts[i] = part
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), counts, score, loss


def _segment_alike(chars: np.ndarray, index: PieceIndex, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units with the same number of characters, one in each row: ids (at the right end of the rows), their number, score and loss."""
    m, n = chars.shape
    rows = np.arange(m)
    slot_of = arc_slots(chars, index)
    arcs = np.where(slot_of >= 0, index.values[slot_of], NEVER)
    alone = slot_of[0] < 0
    if alone.any():
        arcs[0] = np.where(alone, vocabulary.byte_score * utf8_length(chars.T), arcs[0])
    first, second = np.full((n + 1, m), NEVER), np.full((n + 1, m), NEVER)
    first[0] = 0.0
    back = np.ones((n + 1, m), dtype=np.int8)
    for stop in range(1, n + 1):
        for size in range(min(stop, len(arcs)), 0, -1):  # of equal scores the longest last piece stays
            x = first[stop - size] + arcs[size - 1][stop - size]
            y = second[stop - size] + arcs[size - 1][stop - size]
            better = x > first[stop]
            second[stop] = np.where(better, np.maximum(first[stop], y), np.maximum(second[stop], x))
            first[stop] = np.where(better, x, first[stop])
            back[stop] = np.where(better, size, back[stop])
    ids = np.zeros((m, 4 * n), dtype=np.int32)
    number, at = np.zeros(m, dtype=np.int64), np.full(m, n)
    left = rows
    while len(left):
        size = back[at[left], left].astype(np.int64)
        start = at[left] - size
        slot = slot_of[size - 1, start, left]
        known = slot >= 0
        ids[left[known], 4 * n - 1 - number[left[known]]] = index.ids[slot[known]]
        number[left[known]] += 1
        for row, pos in zip(left[~known].tolist(), start[~known].tolist(), strict=True):
            for x in reversed(chr(chars[row, pos]).encode("utf-8", "surrogatepass")):
                ids[row, 4 * n - 1 - number[row]] = vocabulary.byte_ids[x]
                number[row] += 1
        at[left] = start
        left = left[start > 0]
    with np.errstate(invalid="ignore"):
        return ids, number, first[n], first[n] - second[n]


def units_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts, flat, and the offsets of each text in them; what :data:`UNITS` finds in each prepared text."""
    empty = pc.equal(pc.binary_length(text), 0)
    marked = pc.if_else(empty, text, pc.binary_join_element_wise(MARK, text, ""))
    flat, offsets = byte_view(marked)
    begins = np.zeros(len(flat), dtype=bool)
    if len(flat):
        space, line = flat == 32, flat == 10
        begins[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.flatnonzero(begins)
    units = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(flat)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat)))
    return units, np.searchsorted(at, offsets)


class Encoder:
    """Encodes texts with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary, n: int = N_BEST):
        self.vocabulary, self.n, self.index = vocabulary, n, vocabulary.index()
        self.ways: dict[str, list[tuple[float, tuple[int, ...]]]] = {}

    def ways_of(self, unit: str) -> list[tuple[float, tuple[int, ...]]]:
        if len(self.ways) > CACHE_UNITS:
            self.ways.clear()
        if unit not in self.ways:
            self.ways[unit] = n_best(unit, self.vocabulary, self.n)
        return self.ways[unit]

    def encode(self, text: pa.Array) -> Iterator[tuple[np.ndarray, list[float], list[dict[int, int]]]]:
        """For each text: the ids of the best segmentation, the scores of the N best, and for each of these the rank of every unit that isn't at its best."""
        units, offsets = units_of(text)
        distinct, code = unique_words(units)
        flat, counts, score, loss = segment(distinct.to_pylist(), self.index, self.vocabulary)
        starts = np.concatenate([[0], np.cumsum(counts)])
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = code[a:b]
            size = counts[own]
            ends = np.cumsum(size)
            ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[own] - (ends - size), size)]
            merged: list[tuple[float, dict[int, int]]] = [(0.0, {})]
            if self.n > 1 and b > a:
                lost = loss[own]
                few = np.argpartition(lost, self.n - 2)[: self.n - 1] if len(lost) >= self.n else np.arange(len(lost))
                for at in sorted(few.tolist()):
                    ways = self.ways_of(distinct[int(own[at])].as_py())
                    merged = sorted(((x + ways[0][0] - s, {**picks, at: k} if k else picks) for x, picks in merged for k, (s, _) in enumerate(ways)), key=lambda x: x[0])[: self.n]
            total = float(score[own].sum())
            yield ids, [total - x for x, _ in merged], [picks for _, picks in merged]

    def alternatives(self, text: str) -> list[tuple[float, list[int]]]:
        """The N best segmentations of a whole text with their ids."""
        units = UNITS.findall(prepare(text))
        (_, scores, picks), *_ = self.encode(pa.array([text], pa.string()))
        return [(score, [i for at, u in enumerate(units) for i in self.ways_of(u)[own.get(at, 0)][1]]) for score, own in zip(scores, picks, strict=True)]


def decode(ids, vocabulary: Vocabulary) -> bytes:
    """The text (UTF-8) that pieces stand for."""
    return b"".join(map(vocabulary.names.__getitem__, np.asarray(ids).tolist()))[1:]


_encoders: dict[tuple[int, int], Encoder] = {}


def _encoder(shared, n: int) -> Encoder:
    key = (id(shared.value), n)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(shared.value, n)
    return _encoders[key]


ENCODED_SCHEMA = "doc_id bigint, n_chars bigint, n_pieces bigint, pieces array<int>, pieces_sha256 string, best_score double, scores array<double>, decoded_sha256 string, round_trip boolean"


def encode_documents(spark: SparkSession, docs: DataFrame, path: str = VOCABULARY, n: int = N_BEST, with_pieces: bool = True) -> DataFrame:
    """Encode whole texts, decode them again, and report both.

    ``path`` is read on the driver; the vocabulary (fixed, about 2 MB) is broadcast.  Without
    ``with_pieces`` the ids themselves are left out (null).
    """
    Scratch(spark, "sentencepiece")
    shared = spark.sparkContext.broadcast(load_vocabulary(path))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, n)
        vocabulary = shared.value
        for batch in pieces_of(batches):
            out: dict[str, list] = {k: [] for k in ("n_pieces", "pieces", "pieces_sha256", "best_score", "scores", "decoded_sha256", "round_trip")}
            text = pc.fill_null(batch.column("text"), "")
            for x, (ids, scores, _) in zip(text.cast(pa.binary()).to_pylist(), encoder.encode(text), strict=True):
                back = decode(ids, vocabulary)
                out["n_pieces"].append(len(ids))
                out["pieces"].append(ids if with_pieces else None)
                out["pieces_sha256"].append(hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest())
                out["best_score"].append(scores[0])
                out["scores"].append(scores)
                out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                out["round_trip"].append(back == x)
            kinds = {"n_pieces": pa.int64(), "pieces": pa.list_(pa.int32()), "pieces_sha256": pa.string(), "best_score": pa.float64(), "scores": pa.list_(pa.float64()), "decoded_sha256": pa.string(), "round_trip": pa.bool_()}
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.utf8_length(text).cast(pa.int64()), *(pa.array(v, kinds[k]) for k, v in out.items())], names=["doc_id", "n_chars", *out]
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(make, ENCODED_SCHEMA)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark, documents(spark, sf_dir), with_pieces=False).drop("pieces")
