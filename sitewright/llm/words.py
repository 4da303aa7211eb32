"""Words of Arrow text columns as numpy arrays: positions, 64-bit hashes and hashes of word runs.

All functions work inside Spark tasks on one batch at a time. Texts are cut into slices of about a megabyte so that the
arrays stay in the processor's cache; a document is never divided, so every slice holds whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD1342543DE82EF95 | 1
_MASK = (1 << 64) - 1


def _table(codes) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    found[list(codes)] = True
    return found


#: Bytes that part words: ASCII white space, or all ASCII but letters and digits.
WHITE_SPACE = _table([0x20, *range(0x09, 0x0E)])
NOT_ALPHANUMERIC = _table([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole 64-bit value."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_LOWERED = _BYTES.copy()
_LOWERED[0x41:0x5B] = _BYTES[0x61:0x7B]


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, kept as long as they are needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def first(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        if count > len(self.up):
            self.up, self.down = (self._series(base, count + count // 4) for base in (self.base, self.inverse))
        return self.up[:count], self.down[:count]

    @staticmethod
    def _series(base: int, count: int) -> np.ndarray:
        values = np.full(count, base & _MASK, dtype=np.uint64)
        values[0] = 1
        return np.multiply.accumulate(values)


_byte_powers, _word_powers = _Powers(_BASE), _Powers(_STEP)


@dataclass
class Words:
    """Words of consecutive rows. Row r owns the words first[r] to first[r + 1]."""

    row: int
    first: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    prefix: np.ndarray
    text: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def position(self) -> np.ndarray:
        """Place of each word in its own text."""
        return np.arange(len(self.doc)) - self.first[self.doc]

    def parts(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges of the slice, equal for equal bytes."""
        return mixed((self.prefix[end] - self.prefix[start]) * _byte_powers.first(len(self.prefix))[1][start])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)), bounds


def slices(column: pa.Array, separators: np.ndarray, lower: bool) -> Iterator[Words]:
    """Words of a text column, slice by slice; with lower, A-Z count as a-z."""
    if not len(column):
        return
    data, bounds = text_buffers(column)
    low, rows = 0, len(bounds) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + SLICE_BYTES, side="right")) - 1)
        yield _words(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low], low, separators, lower)
        low = high


def _words(text: np.ndarray, bounds: np.ndarray, row: int, separators: np.ndarray, lower: bool) -> Words:
    inside = ~separators[text]
    fresh, last = inside.copy(), inside.copy()
    fresh[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = bounds[:-1][bounds[:-1] < len(text)]
    fresh[edges] = inside[edges]
    before = edges[edges > 0] - 1
    last[before] = inside[before]
    start, end = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    up, down = _byte_powers.first(len(text) + 1)
    prefix = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum((_LOWERED if lower else _BYTES)[text] * up[: len(text)], out=prefix[1:])
    first = np.searchsorted(start, bounds)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Words(row, first, doc, start, end, mixed((prefix[end] - prefix[start]) * down[start]), prefix, text, bounds)


def runs(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of so many words within one text, and the index of its first word."""
    count = len(words.hash) - length + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    up, down = _word_powers.first(len(words.hash) + 1)
    prefix = np.zeros(len(words.hash) + 1, dtype=np.uint64)
    np.cumsum(words.hash * up[: len(words.hash)], out=prefix[1:])
    hashes = mixed((prefix[length:] - prefix[:-length]) * down[:count] + np.uint64(length))
    whole = words.doc[length - 1 :] == words.doc[:count]
    return hashes[whole], np.flatnonzero(whole)


def minima(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` neighbouring values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values
