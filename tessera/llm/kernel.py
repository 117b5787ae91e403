"""Vectorised word kernels over Arrow string buffers.

A batch of texts is one byte buffer with offsets.  Words, their 64-bit hashes and the hashes of word n-grams are found
with numpy over slices of a few MB, so memory is bounded by the slice (or the longest single text) and no Python loop
runs per word.  Both word classes used here treat every byte from 0x80 as a word byte, so byte runs equal code-point
runs in UTF-8.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: bytes of ``[^\x20\x09-\x0D]``
NON_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser (xor-shift-multiply) over uint64."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), SLICE_BYTES + 1)
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


@dataclass
class Slice:
    """Rows ``low..high`` of a batch: bytes, row offsets, and the words in them."""

    low: int
    high: int
    data: np.ndarray  # uint8, lower-cased where asked
    offsets: np.ndarray  # int64, high - low + 1 entries from 0
    starts: np.ndarray  # of words, byte positions in data
    ends: np.ndarray
    first_word: np.ndarray  # per row, index of its first word; one more entry at the end

    @property
    def rows(self) -> int:
        return self.high - self.low

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first_word)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.n_words)

    def span_hasher(self):
        """A function from byte spans (starts, ends) to hashes that depend on the bytes alone."""
        up, down = _POWERS.upto(len(self.data) + 1)
        total = np.empty(len(self.data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE_CODE[self.data] * down[:-1], out=total[1:])
        return lambda starts, ends: mix((total[ends] - total[starts]) * up[starts] + (ends - starts).astype(np.uint64))

    def word_hashes(self) -> np.ndarray:
        return self.span_hasher()(self.starts, self.ends)

    def text(self, word: int) -> bytes:
        return self.data[self.starts[word] : self.ends[word]].tobytes()


def ngram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words; the caller drops those that cross a row's end."""
    n = max(0, len(words) - k + 1)
    out = np.full(n, np.uint64(k), np.uint64)
    for t in range(k):
        out *= _BASE
        out += words[t : t + n]
    return mix(out)


def as_binary(column: pa.Array) -> pa.Array:
    """Nulls as empty, 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    return column.cast(pa.large_binary()) if not pa.types.is_string(column.type) else column.cast(pa.large_string()).cast(pa.large_binary())


def release() -> None:
    """Give freed memory back at a task's end: the worker lives on beside the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def blocks(column: pa.Array, limit: int = SLICE_BYTES, most: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(low, high, bytes, offsets) of runs of rows of about ``limit`` bytes; a longer text makes a block of its own."""
    column = as_binary(column)
    n = len(column)
    if not n:
        return
    _, offset_buf, data_buf = column.buffers()
    offsets = np.frombuffer(offset_buf, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(n, low + most, max(high, low + 1))
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def runs(kinds: np.ndarray, offsets: np.ndarray, single: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of one kind of byte (0: none) within rows; bytes of the kind ``single`` are runs alone."""
    size = len(kinds)
    begin = np.zeros(size + 1, bool)
    stop = np.zeros(size + 1, bool)
    if size:
        differs = kinds[1:] != kinds[:-1]
        if single:
            differs |= kinds[1:] == single
        inside = kinds > 0
        begin[0], stop[size] = inside[0], inside[-1]
        begin[1:size] = differs & inside[1:]
        stop[1:size] = differs & inside[:-1]
        cut = offsets[(offsets > 0) & (offsets < size)]
        begin[cut] |= inside[cut]
        stop[cut] |= inside[cut - 1]
    return np.flatnonzero(begin), np.flatnonzero(stop)


def slices(column: pa.Array, word_bytes: np.ndarray, lower: bool = True, limit: int = SLICE_BYTES, most: int = 1 << 30) -> Iterator[Slice]:
    """Slices of about ``limit`` bytes and at most ``most`` rows."""
    for low, high, part, own in blocks(column, limit, most):
        part = LOWER[part] if lower else part
        starts, ends = runs(word_bytes[part].view(np.uint8), own)
        yield Slice(low, high, part, own, starts, ends, np.searchsorted(starts, own))


def shingle_sets(part: Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles per row as (row, hash), ordered by row then hash; fewer than k words make one shingle."""
    words, count = part.word_hashes(), part.n_words
    grams = ngram_hashes(words, k)
    row = part.row_of_word()
    at = np.arange(len(grams))
    whole = at + k <= part.first_word[row[: len(grams)] + 1]
    rows, hashes = row[: len(grams)][whole], grams[whole]
    if len(short := np.flatnonzero((count > 0) & (count < k))):
        own = []
        for r in short:
            i = part.first_word[r]
            own.append(ngram_hashes(words[i : i + count[r]], int(count[r]))[0])
        rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, np.array(own, np.uint64)])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    if len(rows):
        keep = np.ones(len(rows), bool)
        keep[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        rows, hashes = rows[keep], hashes[keep]
    return rows, hashes


def sums_by_row(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values (modulo 2**64 for uint64) by ascending row number."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    edge = np.searchsorted(rows, np.arange(n + 1))
    return total[edge[1:]] - total[edge[:-1]]
