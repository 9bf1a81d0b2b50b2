"""Vectorised word, shingle and hash kernels over Arrow string columns.

Everything works on the contiguous byte buffer of a column, so the cost is a
few numpy operations per byte and no Python object is made per word.
"""

from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Multiplier of the polynomial word hash; odd, so it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes hashed at a time: the working arrays stay within a few tens of MB.
PIECE = 1 << 20


def separator_table(separators: bytes, lower: bool) -> np.ndarray:
    """Byte -> byte for words: 0 for a separator, A-Z folded where ``lower``; other bytes stay (NUL becomes 255, which is in no UTF-8)."""
    table = np.arange(256, dtype=np.uint8)
    table[0] = 255
    if lower:
        table[65:91] += 32
    table[list(separators)] = 0
    return table


#: White space separates words; nothing else changes.
SPACE = separator_table(b" \t\n\x0b\x0c\r", lower=False)
SPACE_LOWER = separator_table(b" \t\n\x0b\x0c\r", lower=True)
#: Words of letters, digits and all non-ASCII characters, lower-cased in A-Z.
ALNUM_LOWER = separator_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection with full avalanche."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    size = 1 << max(21, int(n + 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        both = []
        for base in (BASE, INVERSE):
            table = np.full(size, base, U64)
            table[0] = 1
            both.append(np.multiply.accumulate(table))
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte span and hash of every word, in order, and the first word of each row.

    The words of row r are those from first[r] up to first[r + 1].
    """
    hashes, starts, ends = [], [], []
    low, total = 0, len(data)
    edges = np.zeros(total + 1, bool)
    edges[offsets] = True
    while low < total:
        high = min(low + PIECE, total)
        while high < total and table[data[high - 1]] and table[data[high]] and not edges[high]:
            step = np.flatnonzero((table[data[high : high + PIECE]] == 0) | edges[high : min(high + PIECE, total)])
            high = high + int(step[0]) if len(step) else min(high + PIECE, total)
        part, edge = table[data[low:high]], edges[low : high + 1]
        inside = part != 0
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        s = np.flatnonzero(inside & (~before | edge[:-1]))
        e = np.flatnonzero(inside & (~after | edge[1:])) + 1
        up, down = powers(len(part))
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64)))
        starts.append(s + low)
        ends.append(e + low)
        low = high
    if not hashes:
        return np.zeros((0, 3), np.int64), np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    start = np.concatenate(starts)
    return np.column_stack([start, np.concatenate(ends)]), np.concatenate(hashes), np.searchsorted(start, offsets)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries; entry i covers i to i + k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= U64(BASE)
        out += hashes[j : n + j]
        out ^= out >> U64(29)
    return mix(out)


def row_shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Distinct sorted shingles of one row: k words each, the whole row when it has fewer, none when it has no word."""
    if not len(hashes):
        return np.zeros(0, U64)
    k = min(k, len(hashes))
    return np.unique(shingles(hashes, k) + U64(k))


def pieces(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text each (one row at least)."""
    _, offsets = text_buffer(column)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim  # glibc only
except (AttributeError, OSError, TypeError):
    _TRIM = None


def give_back() -> None:
    """Hand freed memory to the system: Arrow's pool and the C heap keep what numpy's working arrays took, some 150 MB a worker, through all later tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function whose freed memory is handed back when it ends, as the worker waits or goes on with other tasks."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()  # the frame of ``run`` and its arrays are gone

    return tidied


_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None
