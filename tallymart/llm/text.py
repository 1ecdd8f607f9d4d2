"""Words of whole texts as numpy arrays, read straight from Arrow buffers.

Texts stay one block of UTF-8 bytes per slice; nothing here loops over characters in Python.
A word is a run of bytes other than space and the controls 0x09-0x0D, after A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

# Parts the places of a word's blocks, and words of different lengths.
_PLACE, _LENGTH = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, SLICE_BYTES + 4096)
        known = np.full(size, base, dtype=_U)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        _powers[base] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and len + 1 offsets into them; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    binary = pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = texts.fill_null(b"" if binary else "")
    texts = texts.cast(pa.large_binary() if binary else pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or len(at) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with about ``most`` bytes.

    One longer text makes a slice of its own, so memory follows the longest single text.
    """
    data, at = buffers(texts)
    first, rows = 0, len(at) - 1
    while first < rows:
        last = int(np.searchsorted(at, at[first] + most, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


@dataclass
class Words:
    """Words of a slice in text order."""

    data: np.ndarray  # lower-cased bytes
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    row: np.ndarray  # row of each word
    first: np.ndarray  # rows + 1 offsets into the words
    rows: int

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same in every text and process.

        Each eight bytes are mixed with their place in the word before they are summed up: a
        sum of bytes times powers would give equal hashes to words that are easy to write down.
        Where equal words are promised, bytes decide (``numbers``).
        """
        lengths = self.end - self.start
        blocks = (lengths + 7) >> 3
        last = np.cumsum(blocks)
        if not len(last):
            return np.zeros(0, dtype=_U)
        place = np.arange(last[-1]) - np.repeat(last - blocks, blocks)
        at = np.repeat(self.start, blocks) + 8 * place
        padded = np.concatenate((self.data, np.zeros(8, dtype=np.uint8)))
        value = np.lib.stride_tricks.sliding_window_view(padded, 8)[at].view("<u8")[:, 0]
        # The last block of a word keeps the bytes that are the word's.
        rest = _U(8) * (blocks * 8 - lengths).astype(_U)
        value[last - 1] = value[last - 1] << rest >> rest
        mixed = mix(value + (place.astype(_U) + _U(1)) * _PLACE)
        return mix(np.add.reduceat(mixed, last - blocks) + lengths.astype(_U) * _LENGTH)

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        """The words' bytes without what parts them, and their offsets."""
        lengths = self.end - self.start
        at = np.concatenate(([0], np.cumsum(lengths)))
        return self.data[np.repeat(self.start - at[:-1], lengths) + np.arange(at[-1])], at

    def array(self) -> pa.Array:
        """The words as Arrow binaries."""
        body, at = self.packed()
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(body)]
        )


def words(data: np.ndarray, at: np.ndarray, breaks: np.ndarray = SPACE, lower: bool = True) -> Words:
    """Words between the bytes that ``breaks`` marks; other tables give other notions of a word."""
    if lower:
        data = LOWER[data]
    rows = len(at) - 1
    inside = ~breaks[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(opens)
    end = np.flatnonzero(closes) + 1
    first = np.searchsorted(start, at, side="left")
    row = np.repeat(np.arange(rows), np.diff(first))
    return Words(data, start, end, row, first, rows)


def runs(values: np.ndarray) -> np.ndarray:
    """Starts of runs of equal neighbours, and the length at the end."""
    if not len(values):
        return np.zeros(1, dtype=np.int64)
    return np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]))
