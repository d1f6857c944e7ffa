"""The piece lattice of a text: which vocabulary pieces can stand where.

Shared by SentencePiece encoding and by subword scoring.  A text is prepared with one space
in front; the vocabulary's ``▁`` stands for a space and is a space in everything below, so
that a ``▁`` in a text is a character like any other.  No piece holds a space behind another
character or a line end, so the lattice falls apart into units (a run of spaces with what
follows it, or one line end) and paths of the whole text are paths of its units.  A
character that no piece holds is written with its byte pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

MARK = " "
PREFIX, MISSING = 1.0, 2.0
#: Pieces with this score or less are reserved strings of the vocabulary.
NEVER_MADE = -1e8
#: Characters of a unit up to which it is handled together with others of its length; units that are handled at once.
LONG_UNIT, ROWS_AT_ONCE = 32, 2048
UNITS = re.compile(r"\n| *[^ \n]+| +")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their ids and scores; ``byte_ids``: the piece of each byte value.

    ``table`` has the score of each piece (0 at most) and PREFIX for what is only the beginning of one.
    """

    ids: dict[str, int]
    scores: list[float]
    names: list[bytes]
    byte_ids: list[int]
    byte_score: float
    table: dict[str, float]

    def __hash__(self) -> int:
        return id(self)

    def index(self) -> PieceIndex:
        """``table`` by substring hashes, for whole arrays at once."""
        return PieceIndex(self)


class PieceIndex:
    """Pieces and beginnings of pieces by a rolling hash of their characters, in two-choice tables.

    Every string of the vocabulary's table lies in one of two slots, which are told by its hash.
    Strings are looked up from their first character on; a slot is right if its string is that of the
    former slot and the next character, so strings of equal hashes are told apart.
    """

    FACTOR = np.uint64(0x9E3779B97F4A7C15)
    BITS = 18

    def __init__(self, vocabulary: Vocabulary):
        names = list(vocabulary.table)
        self.longest = max(map(len, names))
        hashes = np.array([self.hash_of(x) for x in names], dtype=np.uint64)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces share a hash")
        values = np.array([vocabulary.table[x] for x in names])
        ids = np.array([vocabulary.ids.get(x, -1) for x in names], dtype=np.int32)
        self.keys = np.zeros(2 << self.BITS, dtype=np.uint64)
        self.values = np.full(2 << self.BITS, MISSING)
        self.ids = np.full(2 << self.BITS, -1, dtype=np.int32)
        self.before = np.full(2 << self.BITS, -1, dtype=np.int32)
        self.last = np.zeros(2 << self.BITS, dtype=np.uint32)
        one, two = (x.tolist() for x in self.slots(hashes))
        owner: dict[int, int] = {}
        for i in range(len(names)):
            now, at = i, one[i]
            while at in owner:  # put the former owner into its other slot
                owner[at], now = now, owner[at]
                at = two[now] if at == one[now] else one[now]
            owner[at] = now
        at, own = np.fromiter(owner, np.int64), np.fromiter(owner.values(), np.int64)
        self.keys[at], self.values[at], self.ids[at] = hashes[own], values[own], ids[own]
        slot_of = {names[i]: a for a, i in zip(at.tolist(), own.tolist(), strict=True)}  # all beginnings of a piece are in the table
        self.before[at] = [slot_of.get(names[i][:-1], -1) for i in own.tolist()]
        self.last[at] = [ord(names[i][-1]) for i in own.tolist()]

    @classmethod
    def hash_of(cls, piece: str) -> int:
        value = 0
        for x in piece:
            value = (value * int(cls.FACTOR) + ord(x) + 1) % (1 << 64)
        return value

    def slots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = hashes ^ (hashes >> np.uint64(31))
        one = (x * np.uint64(0xD1342543DE82EF95)) >> np.uint64(64 - self.BITS)
        two = ((x * np.uint64(0xAF251AF3B0F025B5)) >> np.uint64(64 - self.BITS)) + np.uint64(1 << self.BITS)
        return one.astype(np.int64), two.astype(np.int64)

    def find(self, hashes: np.ndarray, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The slot of each string, or -1, from its hash, the slot of what stands before its last character, and that character."""
        one, two = self.slots(hashes)
        slot = np.where(self.keys[one] == hashes, one, np.where(self.keys[two] == hashes, two, -1))
        return np.where((slot >= 0) & (self.before[slot] == before) & (self.last[slot] == last), slot, -1)


def load_vocabulary(path: str) -> Vocabulary:
    """The normal and byte pieces of a SentencePiece model file, with the scores that it gives."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    ids: dict[str, int] = {}
    byte_ids = [-1] * 256
    names: list[bytes] = [b""] * n
    scores = [0.0] * n
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            names[i] = bytes([int(piece[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            piece = piece.replace("▁", MARK)
            ids[piece] = i
            names[i] = piece.encode()
            scores[i] = float(model.get_score(i))
    if any(MARK in p.lstrip(MARK) or "\n" in p for p in ids):
        raise ValueError("a piece crosses the bounds of units")
    low = min(x for i in ids.values() if (x := scores[i]) > NEVER_MADE) - 10.0  # worse than any piece that text is cut into
    for i in byte_ids:
        if i >= 0:
            scores[i] = low
    table = {p[:k]: PREFIX for p in ids for k in range(1, len(p))} | {p: scores[i] for p, i in ids.items()}
    return Vocabulary(ids, scores, names, byte_ids, low, table)


def prepare(text: str) -> str:
    return MARK + text if text else ""


def arcs_from(unit: str, start: int, vocabulary: Vocabulary) -> list[tuple[int, tuple[int, ...]]]:
    """(end, ids) of the arcs that leave position ``start``; a character without a piece has one arc of byte pieces."""
    ids, table = vocabulary.ids, vocabulary.table
    found = []
    for stop in range(start + 1, len(unit) + 1):
        piece = unit[start:stop]
        if piece not in table:
            break
        if piece in ids:
            found.append((stop, (ids[piece],)))
    if not found or found[0][0] != start + 1:
        found.append((start + 1, tuple(vocabulary.byte_ids[b] for b in unit[start].encode("utf-8", "surrogatepass"))))
    return found


def same_length(units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Groups of units of one length: their indexes and characters (a row for each); then those that are too long, without characters."""
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    order = np.argsort(sizes, kind="stable")
    starts = np.searchsorted(sizes[order], np.arange(1, LONG_UNIT + 2))
    for n in range(1, LONG_UNIT + 1):
        for at in range(starts[n - 1], starts[n], ROWS_AT_ONCE):
            own = order[at : min(starts[n], at + ROWS_AT_ONCE)]
            yield own, np.frombuffer("".join([units[i] for i in own.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
    if starts[LONG_UNIT] < len(units):
        yield order[starts[LONG_UNIT] :], None


def arc_slots(chars: np.ndarray, index: PieceIndex) -> np.ndarray:
    """For units in rows: the index slot of the piece of each size (first axis, from 0) at each position of each unit, or -1."""
    m, n = chars.shape
    wide = chars.astype(np.uint64) + np.uint64(1)
    at_row, at_pos = (x.ravel() for x in np.meshgrid(np.arange(m), np.arange(n), indexing="ij"))
    code = np.zeros(m * n, dtype=np.uint64)
    slot = np.full(m * n, -1, dtype=np.int64)
    found = []
    for size in range(1, min(n, index.longest) + 1):
        last = at_pos + size - 1
        code = code * index.FACTOR + wide[at_row, last]
        slot = index.find(code, slot, chars[at_row, last])
        piece = (slot >= 0) & (index.values[slot] <= 0)
        here = np.full((n, m), -1, dtype=np.int32)
        here[at_pos[piece], at_row[piece]] = slot[piece]
        found.append(here)
        on = (slot >= 0) & (at_pos + size < n)
        at_row, at_pos, code, slot = at_row[on], at_pos[on], code[on], slot[on]
        if not len(code):
            break
    return np.stack(found)


def utf8_length(chars: np.ndarray) -> np.ndarray:
    return 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
