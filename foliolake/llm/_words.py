"""Words of many texts at once: numpy over the byte buffer of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; a longer text is a slice of its own.
SLICE = 1 << 20

BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64 (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def numbers(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BYTE = numbers(256, 7)
#: As BYTE, with A-Z like a-z.
FOLDED = BYTE.copy()
FOLDED[65:91] = BYTE[97:123]
_R = np.uint64(0xD1342543DE82EF95)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"r": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0..n-1 of the base modulo 2**64, or of its inverse."""
    key, base = ("i", _R_INVERSE) if inverse else ("r", _R)
    if len(_powers[key]) < n:
        steps = np.full(max(n, SLICE + 1), base, np.uint64)
        steps[0] = 1
        _powers[key] = np.multiply.accumulate(steps)
    return _powers[key][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary or string column; null texts are empty."""
    if column.null_count:
        column = column.fill_null(b"")
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds of each row in them) for runs of rows of about ``limit`` bytes."""
    at, data = buffers(column)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each row (with the total at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    blank = BLANK[data]
    begin, end = ~blank, ~blank
    begin[1:] &= blank[:-1]
    end[:-1] &= blank[1:]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    begin[first] = ~blank[first]
    last = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    end[last] = ~blank[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, of_byte: np.ndarray = FOLDED) -> np.ndarray:
    """A 64-bit hash of each word."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(of_byte[data] * powers(len(data)), out=total[1:])
    return mixed((total[ends] - total[starts]) * powers(len(data) + 1, True)[starts] + (ends - starts).astype(np.uint64))


def chained(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k consecutive hashes."""
    n = max(0, len(hashes) - k + 1)
    factors = numbers(k, 99) | np.uint64(1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j : n + j] * factors[j]
    return mixed(out)
