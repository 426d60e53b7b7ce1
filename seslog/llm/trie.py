"""An n-gram trie in flat, memory-mapped levels: Elias-Fano sequences and quantised probabilities.

The root's children are middle words. Below each there are the words that follow it, with their probabilities, and the words
before it (its contexts), with the weight that each leaves to shorter contexts; below a context there are the words that follow
both. A level holds the children of all nodes of the level above, node by node, as one monotone sequence of parent * width +
child. A child of the deepest level is not a word but the place of that word among the successors of the middle word (its
context-relative number), which is much smaller; a second sequence says where these begin. A search takes the high bits to a
bucket of the sequence and looks for the low bits inside it; a large batch of searches unpacks the sequence once instead.
"""

from __future__ import annotations

import json
import mmap
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np


MANY = 8  # a batch of more than one value for so many of a sequence unpacks it


# --- monotone sequences -----------------------------------------------------------------------------------------------
def pack_monotone(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Elias-Fano: low bits one after the other, high bits in unary."""
    n = len(values)
    low_bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
    low = np.zeros((n * low_bits + 63) // 64 + 1, dtype=np.uint64)
    x = values.astype(np.uint64)
    if low_bits:
        part = x & np.uint64((1 << low_bits) - 1)
        at = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(low, word, part << shift)
        over = shift + np.uint64(low_bits) > 64
        np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
    high = np.zeros(n + (universe >> low_bits) + 2, dtype=np.uint8)
    high[(x >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
    return {"low": low, "high": np.packbits(high, bitorder="little"), "shape": np.array([n, low_bits, len(high)], dtype=np.int64)}


class Monotone:
    """A packed sequence. The begin of each bucket of high bits is found once, when the sequence is opened."""

    def __init__(self, low: np.ndarray, high: np.ndarray, shape: np.ndarray):
        self.low, (self.n, self.low_bits, size) = low, (int(v) for v in shape)
        bits = np.unpackbits(high, count=size, bitorder="little")
        zeros = np.flatnonzero(bits == 0)
        self.begin = np.concatenate(([0], zeros - np.arange(len(zeros)))).astype(np.int32)  # of bucket i; ends with n
        self.buckets = len(zeros)
        self.ones = np.flatnonzero(bits).astype(np.int64)

    def low_of(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        value = self.low[word] >> shift
        over = shift + np.uint64(self.low_bits) > 64
        value[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return value & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.ones[i] - i).astype(np.uint64) << np.uint64(self.low_bits)) | self.low_of(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, or -1."""
        x = values.astype(np.uint64)
        if self.n and len(x) * MANY >= self.n:  # cheaper to unpack the sequence once
            every = self.get(np.arange(self.n))
            at = np.minimum(np.searchsorted(every, x), self.n - 1)
            return np.where(every[at] == x, at, -1)
        bucket = (x >> np.uint64(self.low_bits)).astype(np.int64)
        known = bucket < self.buckets
        bucket = np.where(known, bucket, 0)
        start = self.begin[bucket].astype(np.int64)
        stop = np.where(known, self.begin[bucket + 1], start).astype(np.int64)
        want, end = x & np.uint64((1 << self.low_bits) - 1), stop.copy()
        while (open_ := np.flatnonzero(start < stop)).size:  # first of the bucket that is not below
            middle = (start[open_] + stop[open_]) >> 1
            below = self.low_of(middle) < want[open_]
            start[open_[below]], stop[open_[~below]] = middle[below] + 1, middle[~below]
        out = np.full(len(x), -1, dtype=np.int64)
        inside = np.flatnonzero(start < end)
        hit = inside[self.low_of(start[inside]) == want[inside]]
        out[hit] = start[hit]
        return out


# --- quantised values -------------------------------------------------------------------------------------------------
def quantise(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and their centres: the values themselves if they are few enough, else the means of equal shares of the sorted values."""
    kind, size = np.uint8 if bits <= 8 else np.uint16, 1 << bits
    order = np.argsort(values)
    ordered = values[order]
    centres = ordered[np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]].astype(np.float64)
    if len(centres) > size:
        starts = np.arange(size, dtype=np.int64) * len(values) // size
        centres = np.add.reduceat(ordered, starts) / np.diff(np.append(starts, len(values)))
    # means of equal values may differ in their last bit, so borders are made to ascend
    above = np.searchsorted(ordered, np.maximum.accumulate((centres[1:] + centres[:-1]) / 2), side="right")
    codes = np.empty(len(values), dtype=kind)
    codes[order] = np.repeat(np.arange(len(above) + 1), np.diff(above, prepend=0, append=len(values)))
    return codes, centres


# --- the trie ---------------------------------------------------------------------------------------------------------
def build(width: int, backoff: np.ndarray, second: tuple, contexts: tuple, third: tuple, bits: int) -> bytes:
    """width: number of words; backoff: log10 weight of each as a context. second: (middle, word, log10 p) sorted by both; contexts:
    (middle, word before, log10 weight) sorted by both; third: (place among contexts, place of middle and word in the second
    level, log10 p) sorted by both. Returns one flat buffer."""
    a, b, p2 = second
    middle, before, weight = contexts
    c, below, p3 = third
    starts = np.searchsorted(a, np.arange(width + 1))
    breadth = int(np.diff(starts).max(initial=0)) + 1
    sequences = {
        "begin2": (starts, len(a) + 1),
        "key2": (a * width + b, width * width),
        "context": (middle * width + before, width * width),
        "key3": (c * breadth + below - starts[middle[c]], (len(middle) + 1) * breadth),
    }
    parts: dict[str, np.ndarray] = {}
    for name, (values, universe) in sequences.items():
        parts |= {f"{name}.{k}": v for k, v in pack_monotone(values, universe).items()}
    for name, values in (("b1", backoff), ("p2", p2), ("b2", weight), ("p3", p3)):
        parts[f"{name}.code"], parts[f"{name}.centre"] = quantise(values, bits)
    parts["size"] = np.array([width, breadth], dtype=np.int64)
    head, body, at = {}, [], 0
    for name, values in parts.items():
        data = np.ascontiguousarray(values).tobytes()
        data += b"\0" * (-len(data) % 8)
        head[name] = [str(values.dtype), len(values), at]
        body.append(data)
        at += len(data)
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(body)


class Trie:
    def __init__(self, buffer):
        size = int.from_bytes(bytes(buffer[:8]), "little")
        head = json.loads(bytes(buffer[8 : 8 + size]))
        view = {k: np.frombuffer(buffer, dtype=t, count=n, offset=8 + size + at) for k, (t, n, at) in head.items()}
        self.width, self.breadth = (int(v) for v in view["size"])
        self.begin2, self.key2, self.context, self.key3 = (
            Monotone(view[f"{k}.low"], view[f"{k}.high"], view[f"{k}.shape"]) for k in ("begin2", "key2", "context", "key3")
        )
        self.value = {k: (view[f"{k}.code"], view[f"{k}.centre"]) for k in ("b1", "p2", "b2", "p3")}

    def _of(self, name: str, at: np.ndarray) -> np.ndarray:
        code, centre = self.value[name]
        return centre[code[at]]

    def log10(self, second: np.ndarray, first: np.ndarray, word: np.ndarray, own: np.ndarray) -> np.ndarray:
        """log10 p(word | second first), given log10 p(word). A context that is not in the trie gives its shorter one."""
        out = own + self._of("b1", first)
        place = self.key2.find(first * self.width + word)
        seen = np.flatnonzero(place >= 0)
        out[seen] = self._of("p2", place[seen])
        context = self.context.find(first * self.width + second)
        at = np.flatnonzero(context >= 0)
        out[at] += self._of("b2", context[at])
        both = np.flatnonzero((context >= 0) & (place >= 0))
        relative = place[both] - self.begin2.get(first[both]).astype(np.int64)
        deep = self.key3.find(context[both] * self.breadth + relative)
        out[both[deep >= 0]] = self._of("p3", deep[deep >= 0])
        return out


@contextmanager
def mapped(data: bytes) -> Iterator[Trie]:
    """The trie of a buffer, mapped from an unnamed scratch file of the task; nothing of it outlives the task."""
    with tempfile.TemporaryFile() as file:
        file.write(data)
        file.flush()
        yield Trie(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
