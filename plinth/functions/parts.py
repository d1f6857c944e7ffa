"""The tokens of many texts at once, for workers; the same as :func:`plinth.functions.text.tokens` gives."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SMALL, _CAPITAL, _DIGIT = 1, 2, 4
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[ord("a") : ord("z") + 1], _KIND[ord("A") : ord("Z") + 1], _KIND[ord("0") : ord("9") + 1] = _SMALL, _CAPITAL, _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (binary, null: none) in one array, and the offsets of each text in it."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def parts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased identifier parts of all texts (binary) in one array, and the offsets of each text in it.

    A part ends at what is no ASCII letter or digit, before a capital behind a small letter or digit, and
    before a capital that a small letter follows.
    """
    flat, ends = bytes_of(texts)
    kind = _KIND[flat]
    before, after = np.zeros_like(kind), np.zeros_like(kind)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    full = np.flatnonzero(np.diff(ends))
    before[ends[full]] = after[ends[full + 1] - 1] = 0  # no part goes on in the next text
    held = kind != 0
    begins = held & ((before == 0) | ((kind == _CAPITAL) & ((before != _CAPITAL) | (after == _SMALL))))
    places = np.flatnonzero(begins)
    letters = _LOWER[flat[held]]
    offsets = np.append(np.flatnonzero(begins[held]), len(letters)).astype(np.int32)
    found = pa.Array.from_buffers(pa.string(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return found, np.searchsorted(places, ends)
