"""Hashes of many texts dealt out to tasks in packed blocks, far smaller than a row each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def deal(key: np.ndarray, row: np.ndarray, parts: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(part, low halves of the keys ascending, their rows) for every part that has keys.

    The part comes from the upper half of the 64-bit key, so part and lower half
    tell keys apart: with parts in proportion to the data, by as many bits for
    every key at any size.
    """
    part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    low = key & np.uint64(0xFFFFFFFF)
    order = np.argsort((part.astype(np.uint64) << np.uint64(32)) | low)
    part, low, row = part[order], low[order].astype("<u4"), row[order].astype("<u4")
    cut = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cut], [*cut, len(part)], strict=True):
        if b > a:
            yield int(part[a]), low[a:b].tobytes(), row[a:b].tobytes()


def equal_keys(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(place, group) of all entries whose key occurs at least twice, by group; places count through the blocks."""
    keys = np.frombuffer(b"".join(blocks), "<u4").astype(np.uint64)
    both = np.sort((keys << np.uint64(32)) | np.arange(len(keys), dtype=np.uint64))
    key, place = both >> np.uint64(32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if len(key) < 2:
        return place[:0], place[:0]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    first = np.ones(len(key), bool)
    first[1:] = ~same
    return place[twice], (np.cumsum(first) - 1)[twice]


def pack_ids(ids: list[int | None]) -> bytes:
    """Ids with their validity; a list would reach pandas as doubles if one of them is null."""
    return np.array([0 if v is None else v for v in ids], "<i8").tobytes() + np.array([v is not None for v in ids], np.uint8).tobytes()


def unpack_ids(data: bytes) -> pd.array:
    n = len(data) // 9
    return pd.arrays.IntegerArray(np.frombuffer(data[: 8 * n], "<i8").astype(np.int64), np.frombuffer(data[8 * n :], np.uint8) == 0)
