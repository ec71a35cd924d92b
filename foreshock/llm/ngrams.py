"""Hashed byte n-gram counts of whole texts as dense rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from foreshock.llm.text import LOWER, text_bytes

#: Turns everything in ASCII that is no letter into a space.
LETTERS = LOWER.copy()
LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def ngram_counts(column: pa.Array, dims: int, sizes: tuple[int, ...], table: np.ndarray | None = None) -> np.ndarray:
    """Counts (rows x dims) of the byte n-grams of each text, after mapping bytes by ``table``.

    ``dims`` is a power of two.  Texts are read whole; n-grams never cross texts.
    """
    buf, at = text_bytes(column)
    rows = len(at) - 1
    if table is not None:
        buf = table[buf]
    out = np.zeros(rows * dims, np.int64)
    if not len(buf):
        return out.reshape(rows, dims).astype(np.float32)
    owner = np.repeat(np.arange(rows, dtype=np.int32), np.diff(at))
    shift = np.uint32(32 - dims.bit_length() + 1)
    code = np.zeros(len(buf), np.uint32)
    for n in range(1, max(sizes) + 1):
        m = len(buf) - n + 1
        if m <= 0:
            break
        code = (code[:m] << np.uint32(8)) | buf[n - 1 :]
        if n in sizes:
            slot = ((code + np.uint32(n)) * np.uint32(2654435761)) >> shift
            place = owner[:m].astype(np.int64) * dims + slot
            if n > 1:
                place = place[owner[:m] == owner[n - 1 :]]
            out += np.bincount(place, minlength=rows * dims)
    return out.reshape(rows, dims).astype(np.float32)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay zero."""
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)
