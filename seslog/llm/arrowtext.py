"""Words of Arrow text columns as NumPy arrays: no Python object per word.

Texts are handled as the UTF-8 bytes Arrow holds. Both word patterns used here are sets of ASCII bytes that end a
word, so byte ranges and character ranges agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 4 << 20
HASH_BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, np.ndarray] = {}

SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_WORDS = np.ones(256, dtype=bool)
ALNUM_WORDS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False

KEEP_CASE = np.arange(256, dtype=np.uint8)
LOWER_ASCII = KEEP_CASE.copy()
LOWER_ASCII[0x41:0x5B] += 0x20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into row ranges of about `limit` bytes of text; a longer text is a range of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = text_bytes(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(bounds, bounds[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < size:
        with np.errstate(over="ignore"):
            for key, base in ((0, _BASE), (1, pow(_BASE, -1, 1 << 64))):
                row = np.full(size, base, dtype=np.uint64)
                row[0] = 1
                _POWERS[key] = np.multiply.accumulate(row)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Words:
    """The words of a block of texts: byte ranges, and where each text's words begin."""

    def __init__(self, column: pa.Array, is_word: np.ndarray = SPACE_WORDS, fold: np.ndarray = LOWER_ASCII):
        raw, self.bounds = text_bytes(column)
        self.buf = fold[raw] if fold is not KEEP_CASE else raw
        inside = is_word[self.buf]
        edges = self.bounds[:-1][self.bounds[:-1] < self.bounds[1:]]  # first bytes of the texts that have any
        before = np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        before[edges] = False
        after = np.empty_like(inside)
        after[-1:], after[:-1] = False, inside[1:]
        after[edges[1:] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.bounds)  # word index at which each text begins
        self.counts = np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial of its bytes, taken from prefix sums, then mixed."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        at = 0
        with np.errstate(over="ignore"):
            while at < len(self.starts):
                base = self.starts[at]
                stop = max(int(np.searchsorted(self.ends, base + HASH_BLOCK, side="right")), at + 1)
                part = self.buf[base : self.ends[stop - 1]]
                power, inverse = _powers(len(part) + 1)
                total = np.zeros(len(part) + 1, dtype=np.uint64)
                np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=total[1:])
                a, b = self.starts[at:stop] - base, self.ends[at:stop] - base
                out[at:stop] = mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))
                at = stop
        return out

    def text(self, word: int, stop: int) -> str:
        """Words word..stop joined by one space."""
        return " ".join(bytes(self.buf[a:b]).decode() for a, b in zip(self.starts[word:stop], self.ends[word:stop]))

    def shingles(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of `size` words inside one text, and the word index each begins at."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(hashes))  # words from here to the text's end
        at = np.flatnonzero(left[:n] >= size)
        with np.errstate(over="ignore"):
            value = np.full(len(at), size, dtype=np.uint64)
            for k in range(size):
                value = mix(value * np.uint64(0x9E3779B97F4A7C15) + hashes[at + k])
        return value, at
