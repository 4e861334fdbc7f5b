"""Vectorised words, word hashes and rolling k-grams over Arrow string columns.

All bytes of a slice of rows are handled at once with numpy: a table look-up marks word bytes, prefix sums of
byte codes times powers of an odd constant give every word's 64-bit hash (modulo 2**64 an odd constant has an
inverse, which moves each word's sum to position 0). No Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
#: Bytes of text that are handled at once; a longer row is a slice of its own.
SLICE = 1 << 19

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Words that are parted by ASCII white space.
NOT_SPACE = ~SPACES
#: Letters, digits and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, U(base), U)
    out[0] = 1
    return np.multiply.accumulate(out)


_CODES = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
_TABLES: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES or len(_TABLES[0]) <= n:
        size = max(SLICE, 1 << int(n).bit_length())
        _TABLES[:] = [_powers(BASE, size), _powers(pow(BASE, -1, 1 << 64), size)]
    return _TABLES[0], _TABLES[1]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8) if at is not None and at.size else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


class Words:
    """The words of rows first..last-1 of a batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, last: int, word: np.ndarray, lower: bool, latin: bool = False):
        self.first, self.last = first, last
        base = offsets[first]
        self.raw = data[base : offsets[last]]
        self.row_at = offsets[first : last + 1] - base
        buf = LOWER[self.raw] if lower else self.raw
        if latin and len(buf):  # capitals of U+00C0..U+00DE
            c = (self.raw[:-1] == 0xC3) & (self.raw[1:] >= 0x80) & (self.raw[1:] <= 0x9E)
            buf = np.array(buf)
            buf[1:][c] += 32
        self.buf = buf
        n = len(buf)
        inside = word[buf]
        starts, ends = inside.copy(), inside.copy()
        if n:
            starts[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            edge = self.row_at[:-1]
            edge = edge[edge < n]
            starts[edge] = inside[edge]
            edge = edge[edge > 0] - 1
            ends[edge] = inside[edge]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        #: Words of row r are at[r]..at[r+1].
        self.at = np.searchsorted(self.start, self.row_at)
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes in each span."""
        up, down = _tables(len(self.buf) + 1)
        if self._sums is None:
            sums = np.zeros(len(self.buf) + 1, U)
            np.cumsum(_CODES[self.buf] * up[: len(self.buf)], out=sums[1:])
            self._sums = sums
        return mix((self._sums[end] - self._sums[start]) * down[start] + (end - start).astype(U))

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def chars(self) -> np.ndarray:
        """For each byte and the end, how many code points start before it, from the slice's begin."""
        out = np.zeros(len(self.raw) + 1, np.int64)
        np.cumsum((self.raw & 0xC0) != 0x80, out=out[1:])
        return out


def slices(column: pa.Array, word: np.ndarray = NOT_SPACE, lower: bool = True, latin: bool = False, size: int | None = None) -> Iterator[Words]:
    data, offsets = string_buffers(column)
    size, first, n = size or SLICE, 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield Words(data, offsets, first, min(last, n), word, lower, latin)
        first = min(last, n)


_MIX = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3)]


def combine(parts: list[np.ndarray], salt: int = 0) -> np.ndarray:
    """One 64-bit hash from several, in order."""
    out = np.full(len(parts[0]), U(int(salt) & (2**64 - 1)), U)
    for k, p in enumerate(parts):
        out = (out if k < 8 else mix(out)) + p * _MIX[k % 8]
    return mix(out)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; row ends are for the caller to mind."""
    n = len(h) - k + 1
    return combine([h[i : i + n] for i in range(k)], k) if n > 0 else np.zeros(0, U)
