"""Whole Arrow batches of text as numpy arrays: words, word hashes, n-gram hashes.

A word is ``[^\\x20\\x09-\\x0D]+``. The kernels work on the UTF-8 bytes of all rows of a batch at
once, so the cost is a few vector operations a byte and no Python object a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_IN_WORD = np.ones(256, bool)
_IN_WORD[[32, 9, 10, 11, 12, 13]] = False
_rng = np.random.default_rng(20_231)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_Q = np.uint64(0x9E3779B97F4A7C15)
_PB = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)


def _pow(n: int) -> np.ndarray:
    """_PB to the powers 0..n-1, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n + 64, _PB, np.uint64))])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of a batch. start, end: byte ranges; row: the row each is in; first: each row's first word, and their number at the end."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes; lower: of A-Z in lower case."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        lens = self.end - self.start
        at = np.zeros(len(lens), np.int64)
        np.cumsum(lens[:-1], out=at[1:])
        inside = _IN_WORD[self.data]
        chars = self.data[inside]
        within = np.arange(len(chars)) - np.repeat(at, lens)
        values = (_LOWER if lower else _BYTE)[chars] * _pow(int(lens.max()))[within]
        return mix(np.add.reduceat(values, at) + lens.astype(np.uint64) * _Q)

    def code_points(self) -> np.ndarray:
        """Code points of each word."""
        heads = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=heads[1:])
        return heads[self.end] - heads[self.start]

    def per_row(self, values: np.ndarray) -> np.ndarray:
        """Sums over each row's words."""
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.first[1:]] - total[self.first[:-1]]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its rows' offsets in them; null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array) -> Words:
    data, offsets = buffers(texts)
    n = len(data)
    inside = _IN_WORD[data]
    head = np.zeros(n + 1, bool)
    head[offsets] = True  # a word never crosses rows
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | head[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | head[1:n]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(data, offsets, start, end, row, np.searchsorted(start, offsets, "left"))


def ngrams(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows, by doubling windows, and whether each lies in one row."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out, window, size, done = None, hashes, 1, 0
    while True:
        if n & size:
            if out is None:
                out, done = window, size
            else:
                k = len(hashes) - done - size + 1
                out = out[:k] * np.uint64(pow(int(_Q), size, 1 << 64)) + window[done : done + k]
                done += size
        if 2 * size > n:
            break
        k = len(hashes) - 2 * size + 1
        window = window[:k] * np.uint64(pow(int(_Q), size, 1 << 64)) + window[size : size + k]
        size *= 2
    return mix(out), row[: len(row) - n + 1] == row[n - 1 :]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a piece has at most so many bytes of the column, or one row: this bounds memory, not text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
