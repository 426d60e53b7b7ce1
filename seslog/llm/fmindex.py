"""A compressed FM-index over a sequence of word numbers: a wavelet matrix of its Burrows-Wheeler transform.

The sequence is the texts of a shard, each followed by a 0. A 0 is smaller than every word and than any later 0, so
suffixes are sorted by what their own text holds. n words over an alphabet of s take n * log2(s) bits and the counts of
the bits before every 64th; the suffix array itself is dropped when the transform is made.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector that tells how many bits are set before a place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, size: int):
        self.levels, self.zeros = [], []
        self.shifts = range(max(int(size - 1).bit_length(), 1) - 1, -1, -1)
        for shift in self.shifts:
            bit = (values >> shift) & 1
            self.levels.append(Bits(bit.astype(np.uint8)))
            self.zeros.append(len(values) - self.levels[-1].ones)
            values = np.concatenate((values[bit == 0], values[bit == 1]))
        self.first = np.zeros(size, dtype=np.int64)
        self.first = self.rank(np.arange(size), np.zeros(size, dtype=np.int64))

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each value stands before each place."""
        start = at
        for shift, level, zeros in zip(self.shifts, self.levels, self.zeros):
            ones = level.rank(at)
            at = np.where((value >> shift) & 1 == 1, zeros + ones, at - ones)
        return at - self.first[value] if len(start) else at


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes, by prefix doubling; each 0 stands for a symbol of its own."""
    n = len(sequence)
    ends = sequence == 0
    rank = np.where(ends, np.cumsum(ends) - 1, sequence + int(ends.sum()))
    reach = 1
    while True:
        ahead = np.zeros(n, dtype=np.int64)
        if reach < n:
            ahead[:-reach] = rank[reach:] + 1
        key = rank * (int(ahead.max(initial=0)) + 1) + ahead
        order = np.argsort(key)
        ordered = key[order]
        number = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1]))) if n else np.zeros(0, dtype=np.int64)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = number
        if not n or number[-1] == n - 1:
            return order
        reach *= 2


class FMIndex:
    """sequence: word numbers from 1 to size - 1 and a 0 after every text; twice marks places that count as two."""

    def __init__(self, sequence: np.ndarray, size: int, twice: np.ndarray):
        order = suffix_array(sequence)
        self.upto = np.concatenate(([0], np.cumsum(np.bincount(sequence, minlength=size)))).astype(np.int64)
        self.transform = WaveletMatrix(sequence[order - 1], size)
        self.twice = Bits(twice[order].astype(np.uint8))

    def back(self, low: np.ndarray, high: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of word + pattern from those of the patterns."""
        ranks = self.transform.rank(np.concatenate((word, word)), np.concatenate((low, high))) + np.concatenate((self.upto[word], self.upto[word]))
        return ranks[: len(word)], ranks[len(word) :]

    def occurrences(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high - low + self.twice.rank(high) - self.twice.rank(low)

    def matching_statistics(self, stream: np.ndarray, ends: np.ndarray, longest: int | np.ndarray, least: int = 2) -> np.ndarray:
        """For each end: the longest run of words of the stream up to it, to a length of `longest` (of all or of each), that the index holds `least` times."""
        lengths, longest = np.zeros(len(ends), dtype=np.int64), np.broadcast_to(longest, len(ends))
        which = np.arange(len(ends))
        low, high = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), self.upto[-1], dtype=np.int64)
        for step in range(int(longest.max(initial=0))):
            at = ends[which] - step
            word = np.where((at >= 0) & (longest[which] > step), stream[np.maximum(at, 0)], 0)
            inside = word > 0
            which, low, high, word = which[inside], low[inside], high[inside], word[inside]
            low, high = self.back(low, high, word)
            found = self.occurrences(low, high) >= least
            which, low, high = which[found], low[found], high[found]
            if not len(which):
                break
            lengths[which] = step + 1
        return lengths
