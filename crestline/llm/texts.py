"""Texts as flat byte buffers: slices of bounded size, words and hashes for whole slices at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: digits, letters a-z (after lower-casing A-Z) and everything outside ASCII.
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = IN_WORD[128:] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BYTE_VALUES = mixed(np.arange(256, dtype=np.uint64) + np.uint64(1000))
_POWERS = mixed(np.arange(256, dtype=np.uint64) + np.uint64(5000)) | np.uint64(1)


def place_factors(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = mixed(np.arange(2 * n, dtype=np.uint64) + np.uint64(5000)) | np.uint64(1)
    return _POWERS


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about ``limit`` bytes of text each; one longer text stands alone."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    first, n = 0, batch.num_rows
    while first < n:
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(first, last - first)
        first = last


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, nulls as empty, and the n + 1 offsets of its rows."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(what, np.uint8) if what is not None and what.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a slice: ``letters[bounds[i]:bounds[i + 1]]`` is word i; row r has words ``rows[r]:rows[r + 1]``."""

    letters: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit value per word, the same everywhere."""
        return piece_hashes(self.letters, self.bounds)

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """Exact codes: index of each word among the slice's distinct words, and these."""
        coded = pieces_array(self.letters, self.bounds).dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def pieces_array(letters: np.ndarray, bounds: np.ndarray) -> pa.Array:
    letters = np.ascontiguousarray(letters)
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(letters)])


def piece_hashes(letters: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n = len(bounds) - 1
    if not n:
        return np.zeros(0, np.uint64)
    sizes = np.diff(bounds)
    factors = place_factors(int(sizes.max()) + 1)
    place = np.arange(len(letters), dtype=np.int64) - np.repeat(bounds[:-1], sizes)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(BYTE_VALUES[letters] * factors[place], bounds[:-1])
        return mixed(sums + sizes.astype(np.uint64))


def edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of every row; no word spans two rows."""
    inside = IN_WORD[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(data):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        first = offsets[:-1][offsets[:-1] < len(data)]
        before[first] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of every row, lower-cased; no word spans two rows."""
    starts, ends = edges(data, offsets)
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    return Words(LOWER[data[IN_WORD[data]]], bounds, starts, ends, np.searchsorted(starts, offsets))


LOWER_VALUES = BYTE_VALUES[LOWER]
_BASE, _CHUNK = 0x5851F42D4C957F2D, 1 << 18
_ROWS_OF_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, at least ``n`` of each."""
    global _ROWS_OF_POWERS
    if not _ROWS_OF_POWERS or n > len(_ROWS_OF_POWERS[0]):
        rows = [np.full(max(n, _CHUNK + 1), x, np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
        for row in rows:
            row[0] = 1
        with np.errstate(over="ignore"):
            _ROWS_OF_POWERS = [np.cumprod(row, dtype=np.uint64) for row in rows]
    return _ROWS_OF_POWERS


def word_values(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value of every lower-cased word, the same everywhere, and the n + 1 places of rows among the words.

    Values are differences of running sums, so bytes are looked at once and words are never copied.
    """
    starts, ends = edges(data, offsets)
    values, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):
        begin = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, begin + _CHUNK, "right")))
        size = int(ends[last - 1] - begin)
        power, inverse = _powers(size + 1)
        sums = np.zeros(size + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(LOWER_VALUES[data[begin : begin + size]] * power[:size], out=sums[1:])
            at = starts[first:last] - begin
            values[first:last] = (sums[ends[first:last] - begin] - sums[at]) * inverse[at]
        first = last
    return mixed(values), np.searchsorted(starts, offsets)
