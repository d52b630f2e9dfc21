"""Word hashing over Arrow text columns, whole batches at a time in numpy.

A block is a slice of an Arrow batch of at most ``BLOCK_BYTES`` of text (one row may exceed it).
Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; a word's hash is a polynomial over
random per-byte values modulo 2**64, finished by a 64-bit mixer, so equal words always agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finisher, so that low bits are as good as high ones."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        table = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            table.append(np.multiply.accumulate(p))
        _powers[size] = (table[0], table[1])
    return _powers[size]


@dataclass
class Block:
    """Words of consecutive rows. ``row_words[i]:row_words[i+1]`` are the words of row ``i``."""

    first_row: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row_words: np.ndarray
    hashes: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.row_words) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.row_words)

    def word_rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts())


def text_array(column: pa.Array) -> pa.Array:
    """The column as a large string array without nulls (null becomes empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    return column.cast(pa.large_string())


def blocks(column: pa.Array, lower: bool, limit: int = BLOCK_BYTES, tidy: bool = False) -> Iterator[Block]:
    """Blocks of a text column, in row order; every row is in exactly one block.

    With ``tidy`` the block's bytes have one space for each run of blanks.
    """
    for at, data, offsets in slices(column, limit):
        if tidy:
            data, offsets = one_space(data, offsets)
        yield hash_block(data, offsets, at, lower)


def hash_block(data: np.ndarray, offsets: np.ndarray, first_row: int, lower: bool) -> Block:
    n = len(data)
    rows = len(offsets) - 1
    if not n:
        none = np.zeros(0, np.int64)
        return Block(first_row, data, none, none, np.zeros(rows + 1, np.int64), np.zeros(0, np.uint64))
    solid = ~_SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    cut = offsets[:-1][offsets[:-1] < n]
    start[cut] = solid[cut]  # a word never crosses from one row to the next
    stop = solid.copy()
    stop[:-1] &= ~solid[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    stop[last] = solid[last]
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(stop) + 1
    up, down = _power_table(n)
    summed = np.empty(n + 1, np.uint64)
    summed[0] = 0
    np.cumsum((_LOWER if lower else _BYTE)[data] * up[:n], out=summed[1:])
    hashes = mix((summed[ends] - summed[starts]) * down[starts])
    return Block(first_row, data, starts, ends, np.searchsorted(starts, offsets).astype(np.int64), hashes)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words: position i covers words i .. i+k-1."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += words[j : j + n]
    return mix(out)


def slices(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive row ranges of at most ``limit`` bytes or one row."""
    column = text_array(column)
    n = len(column)
    if not n:
        return
    _, offsets_buf, data_buf = column.buffers()
    offsets = np.frombuffer(offsets_buf, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def one_space(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of blanks of a row becomes one space."""
    blank = _SPACE[data]
    drop = np.zeros(len(data), bool)
    drop[1:] = blank[1:] & blank[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    drop[heads] = False
    out = np.where(blank, np.uint8(32), data)[~drop]
    kept = np.concatenate([[0], np.cumsum(~drop)])
    return out, kept[offsets]


def word_counts(column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column), np.int64)
    for at, data, offsets in slices(column):
        solid = ~_SPACE[data]
        start = solid.copy()
        start[1:] &= ~solid[:-1]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        start[heads] = solid[heads]
        total = np.concatenate([[0], np.cumsum(start)])
        out[at : at + len(offsets) - 1] = np.diff(total[offsets])
    return out


def as_strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow strings over bytes and offsets."""
    buffers = [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, buffers).cast(pa.string())
