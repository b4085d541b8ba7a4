"""Words, lines and hashes of a batch of texts, as numpy arrays over their UTF-8 bytes.

A batch of texts is one byte array and one array of offsets.  Words are maximal runs of bytes of a
class; as all bytes of a non-ASCII character are above 0x7F, classes over bytes are exact for the
classes used here.  The hash of a span is a polynomial over a random table, read off a prefix sum,
so hashing every word or line of a batch takes a few passes over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that are not white space (0x20, 0x09-0x0D).
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Digits, lower-case letters and everything beyond ASCII.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True


class Texts(NamedTuple):
    """Texts ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


class Spans(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray


def texts(column: pa.Array, lower: bool = False) -> Texts:
    """The texts of an Arrow column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, ends, data = column.buffers()
    if len(column) == 0 or ends is None:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return Texts(LOWER[raw] if lower else raw, offsets - offsets[0])


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` bytes of text; a longer text stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        length = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        place = np.cumsum(length) // most
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [batch.num_rows]])
        for a, b in zip(first[:-1], first[1:]):
            yield batch.slice(int(a), int(b - a))


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so every bit depends on every bit."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= _STEP
    x ^= x >> np.uint64(32)
    x *= _STEP
    x ^= x >> np.uint64(32)
    return x


_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) <= n:
        if n > 3 * SLICE_BYTES:  # a single long text: not kept
            return tuple(_powers_of(b, n) for b in (_BASE, _INVERSE))
        size = n + n // 4
        _powers.update(up=_powers_of(_BASE, size), down=_powers_of(_INVERSE, size))
    return _powers["up"], _powers["down"]


def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hasher:
    """Hashes of any spans of one byte array."""

    def __init__(self, data: np.ndarray):
        up, self._down = _power_table(len(data))
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start])


def runs(found: Texts, kind: np.ndarray) -> Spans:
    """The maximal runs of bytes of a class, in order; no run crosses a text's end."""
    inside = kind[found.data]
    if not len(inside):
        none = np.zeros(0, np.int64)
        return Spans(none, none, none)
    filled = found.offsets[:-1] < found.offsets[1:]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads, tails = found.offsets[:-1][filled], found.offsets[1:][filled] - 1
    first[heads], last[tails] = inside[heads], inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Spans(start, end, np.searchsorted(found.offsets, start, side="right") - 1)


def lines(found: Texts) -> Spans:
    """The parts between line feeds; an empty text has one empty line."""
    breaks = np.flatnonzero(found.data == 10)
    row = np.searchsorted(found.offsets, breaks, side="right") - 1
    start = np.concatenate([found.offsets[:-1], breaks + 1])
    end = np.concatenate([breaks, found.offsets[1:]])
    rows = np.concatenate([np.arange(found.rows), row])
    by_start, by_end = np.lexsort((start, rows)), np.lexsort((end, np.concatenate([row, np.arange(found.rows)])))
    return Spans(start[by_start], end[by_end], rows[by_start])


def coded(found: Texts, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers that tell spans apart by their bytes, the first span of each number, and the distinct spans.

    The spans are in order and don't overlap; numbers follow their first place.
    """
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, pa.array([], pa.large_binary())
    ends = np.stack([start, end], axis=1).ravel().astype(np.int64)
    whole = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(found.data))])
    made = (whole.take(pa.array(np.arange(0, len(ends) - 1, 2))) if len(ends) > 2 else whole).dictionary_encode()
    which = made.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.full(len(made.dictionary), len(which))
    first[which[::-1]] = np.arange(len(which))[::-1]
    return which, first, made.dictionary


def gram_codes(codes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and rows of every run of ``n`` coded words, as ``grams``: equal numbers are equal runs.

    Pairs of numbers are numbered again, doubling what a number stands for.
    """
    if len(codes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]

    out, done, part, size = None, 0, codes, 1
    while done < n:
        if n & size:
            out = part if out is None else joined(out[: len(codes) - done - size + 1], part[done : done + len(codes) - done - size + 1])
            done += size
        if done < n:
            part, size = joined(part[:-size], part[size:]), size * 2
    return out, np.where(row[: len(out)] == row[n - 1 :], row[: len(out)], -1)


def grams(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``n`` words; the position is the first word's index.

    Runs that would cross a text's end are marked by row -1.
    """
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(hashes) - n + 1
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out *= _STEP
        out += hashes[i : i + size]
    owner = np.where(row[:size] == row[n - 1 :], row[:size], -1)
    return mix(out), owner


def keyed(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """One key per (row, hash)."""
    return mix(hashes + mix(row.astype(np.uint64) + np.uint64(1)))


def of_row(codes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """One number per (row, code)."""
    return row * (int(codes.max(initial=0)) + 1) + codes


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a byte-wise array by text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def count_rows(row: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, minlength=rows).astype(np.int64)


def numbered(row: np.ndarray) -> np.ndarray:
    """Position of each span within its text, from 0; ``row`` is in order."""
    if not len(row):
        return np.zeros(0, np.int64)
    first = np.concatenate([[True], row[1:] != row[:-1]])
    at = np.arange(len(row))
    return at - np.maximum.accumulate(np.where(first, at, 0))


def cut_out(found: Texts, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans as an Arrow binary column."""
    size = end - start
    ends = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    index = np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)
    return pa.Array.from_buffers(
        pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(found.data[index].tobytes())]
    )
