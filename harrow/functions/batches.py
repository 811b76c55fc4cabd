"""Tokens of Arrow batches: whole columns at once, no Python per row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: For each byte: 0, or the byte of its lower-case form where the byte belongs to a token.
_TOKEN_BYTE = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _TOKEN_BYTE[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _TOKEN_BYTE[_c] = _c + 32


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased tokens of all texts in order, and the row of each. Null and empty texts have none.

    Tokens are maximal runs of ASCII letters and digits, so the bytes of any other character end one.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    first, last = int(offsets[0]), int(offsets[-1])
    if data is None or first == last:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    mapped = _TOKEN_BYTE[np.frombuffer(data, np.uint8)[first:last]]
    inside = mapped != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1] - first
    edges = edges[edges < last - first]
    begins[edges] |= inside[edges]
    starts = np.flatnonzero(begins)
    kept = mapped[inside]
    bounds = np.append((np.cumsum(inside) - 1)[starts], len(kept)).astype(np.int64)
    rows = np.searchsorted(offsets - first, starts, side="right") - 1
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.tobytes()), pa.py_buffer(kept.tobytes())), rows


def coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens, the code of each token in order, the row of each."""
    words, rows = tokens(texts)
    encoded = words.dictionary_encode()
    return encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows
