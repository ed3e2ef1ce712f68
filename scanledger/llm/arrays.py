"""Texts of an Arrow batch as numpy arrays of UTF-8 bytes: words, word hashes and runs of whole documents.

Everything here works on one batch of documents inside a task. Arrays of eight bytes per text byte are only made for ``chunks``: runs of
documents of about a megabyte, or a single longer document.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C55)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_POWERS = [np.ones(1, U64), np.ones(1, U64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words between white space.
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
#: Bytes of words of letters and digits, all characters above ASCII included.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offsets of its rows in them; NULL is ''."""
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole rows of at most ``limit`` bytes, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes in the set ``of`` that stay within a row, and how many rows' runs begin at each row."""
    inside = of[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    rows = offsets[:-1][np.diff(offsets) > 0]
    start[rows] = inside[rows]
    lasts = offsets[1:][np.diff(offsets) > 0] - 1
    end[lasts] = inside[lasts]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def mixed(h: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit hashes."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Hash sums of all prefixes, for ``span_hashes``."""
    while len(_POWERS[0]) <= len(data):
        for k, b in enumerate((_BASE, _INVERSE)):
            _POWERS[k] = np.concatenate([_POWERS[k], _POWERS[k] * _POWERS[k][-1] * b])
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * _POWERS[0][:len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from starts to ends: equal bytes have equal hashes wherever they stand."""
    return mixed((sums[ends] - sums[starts]) * _POWERS[1][starts] + (ends - starts).astype(U64))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every (start, count), one after the other."""
    total = int(counts.sum())
    if total == 0:
        return np.empty(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def list_array(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """A list column of rows with ``counts`` consecutive values each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
