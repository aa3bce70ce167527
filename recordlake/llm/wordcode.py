"""Vectorised word splitting and hashing over Arrow text columns.

A batch's UTF-8 buffer is classified byte by byte, so no Python string is made. Word hashes are
64-bit polynomial differences of a running sum; window hashes are the same construction over words.
All functions work on slices of bounded size (one text is never cut).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 512 << 10
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """True for every byte outside the inclusive separator ranges."""
    table = np.ones(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: ``[^\x20\x09-\x0D]+``
SPACE_WORDS = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM_WORDS = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE_CODES = np.random.default_rng(20260801).integers(1, 2**64, 256, dtype=np.uint64)


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64, at least ``n`` of each."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = np.uint64(_MULTIPLIERS[which])
        inverse = np.uint64(pow(_MULTIPLIERS[which], -1, 2**64))
        up = np.full(size, base, dtype=np.uint64)
        down = np.full(size, inverse, dtype=np.uint64)
        up[0] = down[0] = 1
        have = (np.cumprod(up), np.cumprod(down))
        if size <= 8 << 20:
            _powers[which] = have
    return have


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of each byte range; ``which`` 0 and 1 are independent."""
    n = len(data)
    up, down = powers(which, n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[data if which == 0 else data ^ 0x5A] * up[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64), which)


@dataclass
class Words:
    """Words of a slice of texts; ``first[i]:first[i + 1]`` are those of text ``i``."""

    data: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        return range_hashes(self.data, self.start, self.end)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Parts of a string column of about ``limit`` bytes each, with the row each begins at; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, column.slice(row, stop - row)
        row = stop


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a null-free large_string array and the offsets of its texts in them."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def split_words(column: pa.Array, word_bytes: np.ndarray, lower: bool) -> Words:
    data, at = text_buffer(column)
    if lower:
        data = LOWER[data]
    inside = word_bytes[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    before = np.empty(len(data), dtype=bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
        before &= ~edge[:-1]
        after = np.empty(len(data), dtype=bool)
        after[-1] = False
        after[:-1] = inside[1:]
        after &= ~edge[1:]
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
    else:
        start = end = np.zeros(0, dtype=np.int64)
    return Words(data, at, start, end, np.searchsorted(start, at))


def window_hashes(codes: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of every run of ``width`` consecutive codes (runs may cross texts; the caller masks those)."""
    n = len(codes)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(which, n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(codes, which) * up[:n], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[: n - width + 1], which + 7)
