"""LM scoring: a trigram model of all words and n-grams of the training texts, asked through Elias-Fano tries.

Words are runs of other than space and ASCII control blanks, A-Z lower-cased; each text ends with one end token. Every
word, bigram and trigram that is counted is kept, singletons too, at any corpus size; the model grows with the corpus and
neither a task nor the driver holds it as a whole. Only words with a share of 2^-20 or more (at most 2^20) are known to
every task, so that their counts need no join; the counts are the same either way.

p(word | context) interpolates by absolute discounting: (c - D) / n of the context, and the mass D * kinds / n goes to the
shorter context; below it is (c + 1) / (N + V + 1), where all unseen words are one more word. A context that was never
seen gives its shorter one.

Each block of texts sends its trigrams, sorted and packed (a few bytes each), to ranges of the middle word: the bigram and
both contexts of a trigram have the same middle word, so a range knows all it needs. It builds one trie of the training
n-grams, maps it, asks it for all trigrams it was sent and returns sums per text; the texts themselves move nowhere. A
range gets about `range_tokens` tokens. A middle word of more than `hot` tokens, or of a share of 2^-8 or more at any size, is
split by the word before it (the begin of a text by the word after it), and its bigram counts, summed beforehand, are sent to
all its ranges. One pair of words is not split: the packed trigrams of a pair meet in one task.

A trie's probabilities have codes of `bits` bits. They are exact where a level of a range has at most 2^bits different
values; else each is the mean of a share of 2^-bits of the level's sorted values.

Defined cases: a null or empty text is its end token; a null held_out is training; repeated rows count each; without
training texts every word is unknown and log10 p is 0 in both scores; other columns are not read. Words are compared by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seslog.llm import trie as tries
from seslog.llm.arrowtext import Words, blocks, mix
from seslog.llm.common import stage

KNOWN_SHARE, SPLIT_SHARE = 20, 8
DISCOUNT = 0.75
RANGE_TOKENS, HOT, BITS = 1 << 20, 1 << 19, 16
END = np.uint64(0xE4D0F7E87)  # the end token among word hashes
BEGIN, NONE = np.uint64(0xBE617), np.uint64(0x9017E)  # what stands before a text's first token, and before that
FLUSH, BLOCK = 1 << 21, 16 << 20
TEXT, PAIRS, ROWS = 0, 1, 2  # kinds of pieces
PIECE = "range int, kind int, block long, rare binary, v binary, u binary, w binary, row binary, extra binary"


@dataclass
class Lexicon:
    """Frequent words by hash: training counts, ranks by frequency, and over how many ranges each is split as a middle word."""

    words: np.ndarray
    counts: np.ndarray
    ranks: np.ndarray
    parts: np.ndarray
    begin_parts: int
    ranges: int
    total: int
    distinct: int

    @property
    def begin(self) -> int:
        """The number of the begin of a text; the next is what stands before it, then come the rare words of a piece."""
        return len(self.words)

    @cached_property
    def _starts(self) -> tuple[np.ndarray, np.uint64]:
        """Where the words begin that share their high bits, and by how much hashes are shifted to these."""
        shift = 63 - len(self.words).bit_length()
        return np.searchsorted(self.words, np.arange(1 << (64 - shift), dtype=np.uint64) << np.uint64(shift)).astype(np.int32), np.uint64(shift)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first word that is not below each hash (or of the last word), and whether it is that word."""
        if not len(self.words):
            return np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=bool)
        starts, shift = self._starts
        last = len(self.words) - 1
        at = np.minimum(starts[hashes >> shift], last).astype(np.int64)
        word = self.words[at]
        below = np.flatnonzero(word < hashes)
        while len(below := below[at[below] < last]):
            at[below] += 1
            word[below] = self.words[at[below]]
            below = below[word[below] < hashes[below]]
        return at, word == hashes

    def parts_of(self, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Over how many ranges words are split that were looked up by find."""
        return np.where(known, self.parts[at], 1) if len(self.words) else np.ones(len(at), dtype=np.int64)

    def range_of(self, middle: np.ndarray, part: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(mix(middle) + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.ranges)).astype(np.int32)

    def numbers(self, hashes: np.ndarray, at: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words that were looked up by find, and the sorted hashes of the rare ones, whose numbers follow each other."""
        out = self.ranks[at] if len(self.words) else np.zeros(len(hashes), dtype=np.int64)
        rare, inverse = np.unique(hashes[~known], return_inverse=True)
        out[~known] = self.begin + 2 + inverse
        return out, rare


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens with each text's end, and where texts begin."""
    words = Words(column)
    first = words.first + np.arange(len(words.first))
    out = np.empty(first[-1], dtype=np.uint64)
    is_end = np.zeros(len(out), dtype=bool)
    is_end[first[1:] - 1] = True
    out[is_end], out[~is_end] = END, words.hashes()
    return out, first


def _before(word: np.ndarray, first: np.ndarray, begin, none) -> tuple[np.ndarray, np.ndarray]:
    """What stands two places and one place before each token, if `begin` stands before a text and `none` before that."""
    before, second = np.empty_like(word), np.empty_like(word)
    before[1:], second[2:] = word[:-1], word[:-2]
    starts = first[:-1]
    before[starts] = begin
    second[starts], second[starts[np.diff(first) > 1] + 1] = none, begin
    return second, before


def _training(batch: pa.RecordBatch) -> np.ndarray:
    return ~batch.column(batch.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False).astype(bool)


def _text(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.get_field_index("text"))


def _ranges(lexicon: Lexicon, word: np.ndarray, first: np.ndarray, at: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The range of the trigram that each token ends."""
    u, v = _before(word, first, BEGIN, NONE)
    parts = _before(lexicon.parts_of(at, known), first, lexicon.begin_parts, 1)[1]
    part = np.zeros(len(v), dtype=np.uint64)
    split = parts > 1
    part[split] = mix(np.where(v[split] == BEGIN, word[split], u[split])) % parts[split].astype(np.uint64)
    return lexicon.range_of(v, part)


# --- words ------------------------------------------------------------------------------------------------------------
def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, c, m): how often each word occurs in training texts and in all, combined inside a task before rows leave it."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def combined(keys, c, m) -> tuple[np.ndarray, ...]:
        keys, inverse = np.unique(keys, return_inverse=True)
        return keys, *(np.bincount(inverse, weights=x, minlength=len(keys)).astype(np.int64) for x in (c, m))

    def rows(keys: np.ndarray, c: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(c), pa.array(m)], ["key", "c", "m"])

    for batch in blocks(batches, "text"):
        word, first = _tokens(_text(batch))
        held.append(combined(word, np.repeat(_training(batch), np.diff(first)), np.ones(len(word))))
        if sum(len(x[0]) for x in held) > 2 * FLUSH:
            held = [combined(*(np.concatenate(x) for x in zip(*held)))]
            if len(held[0][0]) > FLUSH:
                yield rows(*held.pop())
    if held:
        yield rows(*combined(*(np.concatenate(x) for x in zip(*held))))


def learn_words(source: DataFrame, range_tokens: int = RANGE_TOKENS, hot: int = HOT) -> tuple[DataFrame, Lexicon]:
    """The count table (key, c, m) of all words of source (held_out, text), and the frequent ones."""
    tallied = source.select("held_out", "text").mapInArrow(_tally, "key long, c long, m long")
    counts = stage(tallied.groupBy("key").agg(F.sum("c").alias("c"), F.sum("m").alias("m")))
    facts = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.sum("m").alias("all")).first()
    every = facts["all"] or 0
    rows = counts.filter(F.col("m") * F.lit(1 << KNOWN_SHARE) >= every).toPandas()
    words = rows["key"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(words)
    words, c, m = words[order], rows["c"].to_numpy(dtype=np.int64)[order], rows["m"].to_numpy(dtype=np.int64)[order]
    ranks = np.empty(len(m), dtype=np.int64)
    ranks[np.lexsort((words, -m))] = np.arange(len(m))
    parts = np.maximum(-(-m // hot), np.where((m << SPLIT_SHARE) >= every, 2, 1))
    lexicon = Lexicon(words, c, ranks, parts, 1, max(1, -(-every // range_tokens)), facts.n or 0, facts.v)
    lexicon.begin_parts = int(parts[words == END].max(initial=1))  # as many texts begin as end
    return counts, lexicon


# --- packed pieces ----------------------------------------------------------------------------------------------------
def _packed(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes: the lowest byte of each, the second lowest and so on."""
    if not len(values):
        return b""
    width = values.dtype.itemsize
    whole, planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), width), np.empty((width, len(values)), dtype=np.uint8)
    for k in range(width):
        planes[k] = whole[:, k]
    return len(values).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def sorted_by(place: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The order of rows by place and number, equal ones as they stand. Where all fits 63 bits, whole keys are sorted."""
    n, inner = len(place), int(number.max(initial=0)).bit_length()
    least = n.bit_length()
    if int(place.max(initial=0)).bit_length() + inner + least > 63:
        return np.lexsort((number, place))
    key = ((place.astype(np.int64) << inner | number) << least) | np.arange(n)
    key.sort()
    return key & ((1 << least) - 1)


def _unpacked(data: bytes, dtype=np.uint32) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=dtype)
    n, width = int.from_bytes(data[:4], "little"), np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data[4:], decompressed_size=n * width, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(dtype).reshape(n)


def _rows_of_pieces(pieces: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 6]
    names = [x.split()[0] for x in PIECE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*pieces), types)], names)


def _pieces(shared):
    """Per block of texts: a packed run of trigrams for each range, and one piece with the rows' own columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon: Lexicon = shared.value
        base = lexicon.begin + 2
        block = TaskContext.get().partitionId() << 32
        for batch in blocks(batches, "text", BLOCK):
            word, first = _tokens(_text(batch))
            at, known = lexicon.find(word)
            training = _training(batch)
            row = np.repeat(np.arange(batch.num_rows) * 2 + training, np.diff(first))
            place = _ranges(lexicon, word, first, at, known)
            counted = known & (lexicon.counts[at] > 0) if len(lexicon.words) else known
            logs = np.where(counted, np.log10(lexicon.counts[at] + 1.0), 0.0) if len(lexicon.words) else np.zeros(len(word))
            sums = [pa.array(np.diff(first)), pa.array(np.add.reduceat(counted.astype(np.int64), first[:-1])), pa.array(np.add.reduceat(logs, first[:-1]))]
            w, rare = lexicon.numbers(word, at, known)
            u, v = _before(w, first, lexicon.begin, lexicon.begin + 1)
            order = sorted_by(place, v)
            u, v, w, row, place = (x[order] for x in (u, v, w, row, place))
            cuts = np.flatnonzero(np.diff(place, prepend=-1))
            out = []
            for a, b in zip(cuts, np.append(cuts[1:], len(w))):
                own = np.concatenate((u[a:b], v[a:b], w[a:b]))
                is_rare = own >= base
                used, inverse = np.unique(own[is_rare], return_inverse=True)
                own[is_rare] = base + inverse
                own = own.reshape(3, b - a)
                # middle words and hashes ascend: only their steps are kept
                steps = np.diff(own[1], prepend=0)
                hashes = np.diff(rare[used - base], prepend=np.uint64(0))
                out.append((int(place[a]), TEXT, block, _packed(hashes), _packed(steps.astype(np.uint32)), *(_packed(x.astype(np.uint32)) for x in (own[0], own[2], row[a:b])), None))
            own = pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(~training), *sums], ["doc_id", "held_out", "n_tokens", "n_known", "logs"]
            )
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(own)
            back = int(mix(np.array([block], dtype=np.uint64))[0] % np.uint64(lexicon.ranges))
            out.append((back, ROWS, block, None, None, None, None, None, sink.getvalue().to_pybytes()))
            yield _rows_of_pieces(out)
            block += 1

    return run


def _asked(shared):
    """(range, key): the rare words whose counts a range needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon: Lexicon = shared.value
        for batch in blocks(batches, "text", BLOCK):
            word, first = _tokens(_text(batch))
            at, known = lexicon.find(word)
            place, w = _ranges(lexicon, word, first, at, known)[~known], word[~known]
            order = np.lexsort((w, place))
            place, w = place[order], w[order]
            new = np.ones(len(w), dtype=bool)
            new[1:] = (place[1:] != place[:-1]) | (w[1:] != w[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(place[new]), pa.array(w[new].view(np.int64))], ["range", "key"])

    return run


def _hot_pairs(shared):
    """(v, w, c): training bigrams of the middle words that are split, combined per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon: Lexicon = shared.value
        for batch in blocks(batches, "text", BLOCK):
            w, first = _tokens(_text(batch))
            _, v = _before(w, first, BEGIN, NONE)
            parts = _before(lexicon.parts_of(*lexicon.find(w)), first, lexicon.begin_parts, 1)[1]
            some = (parts > 1) & np.repeat(_training(batch), np.diff(first))
            order = np.lexsort((w[some], v[some]))
            v, w = v[some][order], w[some][order]
            new = np.ones(len(v), dtype=bool)
            new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(v[at].view(np.int64)), pa.array(w[at].view(np.int64)), pa.array(np.diff(np.append(at, len(v))))], ["v", "w", "c"])

    return run


def _pairs_to_ranges(shared):
    """Summed bigrams (v, w, c) as one piece for each range that has a part of v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon: Lexicon = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v, w, c = (batch.column(k).to_numpy() for k in range(3))
            v, w = v.view(np.uint64), w.view(np.uint64)
            order = np.argsort(v, kind="stable")
            v, w, c = v[order], w[order], c[order]
            cuts = np.flatnonzero(np.diff(v, prepend=v[0] ^ np.uint64(1)) != 0)
            for a, b in zip(cuts, np.append(cuts[1:], len(v))):
                numbers, rare = lexicon.numbers(w[a:b], *lexicon.find(w[a:b]))
                at, known = lexicon.find(v[a : a + 1])
                begins = v[a] == BEGIN
                middle = np.full(1, lexicon.begin if begins else lexicon.ranks[at[0]], dtype=np.uint32)
                parts = lexicon.begin_parts if begins else int(lexicon.parts_of(at, known)[0])
                data = (_packed(np.diff(rare, prepend=np.uint64(0))), _packed(middle), None, _packed(numbers.astype(np.uint32)), None, _packed(c.astype(np.uint64)[a:b]))
                ranges = np.unique(lexicon.range_of(np.repeat(v[a], parts), np.arange(parts)))
                for k in range(0, len(ranges), 64):
                    yield _rows_of_pieces([(int(r), PAIRS, 0, *data) for r in ranges[k : k + 64]])

    return run


# --- ranges -----------------------------------------------------------------------------------------------------------
def learn_range(width: int, none: int, p1: np.ndarray, grams: tuple[np.ndarray, ...], pairs: tuple[np.ndarray, ...], bits: int = BITS) -> bytes:
    """The trie of the training trigrams (u, v, w, c), sorted by v, u and w. Words have numbers below width; p1 are their own
    probabilities; `none` is the number before the begin of a text. pairs (v, w, c) are the bigrams of words that have others elsewhere."""
    u, v, w, c = grams
    counted = np.bincount(pairs[0], minlength=width) > 0
    own = ~counted[v]
    key2, place = np.unique(v[own] * width + w[own], return_inverse=True)
    c2 = np.concatenate((np.bincount(place, weights=c[own], minlength=len(key2)), pairs[2]))
    key2 = np.concatenate((key2, pairs[0] * width + pairs[1]))
    order = np.argsort(key2)
    key2, c2 = key2[order], c2[order]
    a, b = key2 // width, key2 % width
    n2, k2 = np.bincount(a, weights=c2, minlength=width), np.bincount(a, minlength=width)
    weight1 = np.divide(DISCOUNT * k2, n2, out=np.ones(width), where=n2 > 0)
    p2 = (c2 - DISCOUNT) / n2[a] + weight1[a] * p1[b]

    deep = u != none
    pair = v[deep] * width + u[deep]
    new = np.diff(pair, prepend=-1) != 0
    contexts, at = pair[new], np.cumsum(new) - 1
    c3 = c[deep]
    n3, k3 = np.bincount(at, weights=c3, minlength=len(contexts)), np.bincount(at, minlength=len(contexts))
    weight2 = DISCOUNT * k3 / np.maximum(n3, 1)
    below = np.searchsorted(key2, v[deep] * width + w[deep])
    p3 = (c3 - DISCOUNT) / n3[at] + weight2[at] * p2[below] if len(at) else np.zeros(0)
    return tries.build(width, np.log10(weight1), (a, b, np.log10(p2)), (contexts // width, contexts % width, np.log10(weight2)), (at, below, np.log10(p3)), bits)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values, and the place of each value among them."""
    order = np.argsort(values)
    values = values[order]
    new = np.append(True, values[1:] != values[:-1])[: len(values)]
    place = np.empty(len(values), dtype=np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return values[new], place


def _answers(shared, bits: int):
    """Of one range: per block the sums of log10 p by row, and the known rare words of each row."""

    def run(pieces: pa.Table, found: pa.Table) -> pa.Table:
        lexicon: Lexicon = shared.value
        base = lexicon.begin + 2
        column = {name: pieces.column(name).to_pylist() for name in pieces.column_names}
        kind = column["kind"]
        rares = [np.cumsum(_unpacked(x, np.uint64), dtype=np.uint64) for x in column["rare"]]
        words = np.sort(np.concatenate([np.zeros(0, dtype=np.uint64), *rares]))
        words = words[np.append(True, words[1:] != words[:-1])[: len(words)]]
        width = base + len(words)
        c1 = np.zeros(width)
        c1[lexicon.ranks] = lexicon.counts
        def numbered(data: bytes, k: int) -> np.ndarray:
            return placed(_unpacked(data).astype(np.int32), k)

        def placed(numbers: np.ndarray, k: int) -> np.ndarray:
            rare = numbers >= base
            numbers[rare] = base + np.searchsorted(words, rares[k][numbers[rare] - base])
            return numbers

        texts = [k for k, x in enumerate(kind) if x == TEXT]
        hot = [k for k, x in enumerate(kind) if x == PAIRS]
        joined = lambda parts, dtype=np.int64: np.concatenate([np.zeros(0, dtype=dtype), *parts])
        linked = [np.full(len(_unpacked(column["w"][k])), _unpacked(column["v"][k])[0], dtype=np.int64) for k in hot]
        pairs = (joined(linked), joined([numbered(column["w"][k], k) for k in hot]), joined([_unpacked(column["extra"][k], np.uint64).astype(np.int64) for k in hot]))
        # a range may hold many tokens: columns are let go once they are unpacked, and of rows only what is asked for later stays
        rows = [_unpacked(column["row"][k]) for k in texts]
        training = joined([(x & np.uint32(1)).astype(bool) for x in rows], bool)
        key = joined([placed(np.cumsum(_unpacked(column["v"][k]), dtype=np.int64), k) for k in texts])
        key *= width
        key += joined([numbered(column["u"][k], k) for k in texts], np.int32)
        w = joined([numbered(column["w"][k], k) for k in texts], np.int32)
        for name in ("row", "v", "u", "w"):
            del column[name]
        # a rare word that was not looked up occurs once: in training, if that is here
        c1[w[training & (w >= base)]] = 1
        looked_up = found.column("key").to_numpy().view(np.uint64)
        c1[base + np.searchsorted(words, looked_up)] = found.column("c").to_numpy()
        p1 = (c1 + 1) / (lexicon.total + lexicon.distinct + 1)
        contexts = None
        if width**3 >= 1 << 63:
            contexts, key = distinct(key)
            key = key.astype(np.int64)
        key *= width
        key += w
        keys, gram = distinct(key)
        del key

        def words_of(keys: np.ndarray) -> tuple[np.ndarray, ...]:
            of = keys // width if contexts is None else contexts[keys // width]
            return of % width, of // width, keys % width

        counted = np.bincount(gram, weights=training, minlength=len(keys)).astype(np.int64)
        seen = counted > 0
        grams = *words_of(keys[seen]), counted[seen]
        del training, counted, seen
        data = learn_range(width, lexicon.begin + 1, p1, grams, pairs, bits)
        del grams
        with tries.mapped(data) as model:
            del data
            u, v, last = words_of(keys)
            every = model.log10(u, v, last, np.log10(p1[last]))[gram]
            del u, v, keys, gram
            start, out = 0, []
            for k, row in zip(texts, rows):
                stop = start + len(row)
                last = w[start:stop]
                logs = every[start:stop]
                present, inverse = np.unique(row >> 1, return_inverse=True)
                rare = (last >= base) & (c1[last] > 0)
                sums = np.bincount(inverse, weights=logs).astype(np.float32)
                out.append((column["block"][k], *(_packed(x) for x in (present.astype(np.uint32), sums, row[rare].astype(np.uint32) >> 1, c1[last[rare]].astype(np.uint32))), None))
                start = stop
        out += [(column["block"][k], None, None, None, None, column["extra"][k]) for k, x in enumerate(kind) if x == ROWS]
        types = (pa.int64(), *[pa.binary()] * 5)
        names = ["block", "row", "score", "rare_row", "rare_c", "own"]
        return pa.table([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=names)

    return run


def _put_together(lexicon_total: int, lexicon_distinct: int):
    """The rows of one block with the sums that its ranges returned."""
    base = float(np.log10(lexicon_total + lexicon_distinct + 1))

    def run(parts: pa.Table) -> pa.Table:
        column = {name: parts.column(name).to_pylist() for name in parts.column_names}
        own = pa.ipc.open_stream(next(x for x in column["own"] if x is not None)).read_all()
        n_tokens, n_known, logs = (own.column(name).to_numpy().copy() for name in ("n_tokens", "n_known", "logs"))
        score = np.zeros(len(n_tokens))
        # always in the same order, so that the sums of floats are the same in every run
        answers = sorted(x for x in zip(*(column[name] for name in ("row", "score", "rare_row", "rare_c"))) if x[0] is not None)
        for row, value, rare_row, rare_c in answers:
            np.add.at(score, _unpacked(row).astype(np.int64), _unpacked(value, np.float32).astype(np.float64))
            at = _unpacked(rare_row).astype(np.int64)
            np.add.at(n_known, at, 1)
            np.add.at(logs, at, np.log10(_unpacked(rare_c) + 1.0))
        total = pa.array(np.full(len(score), lexicon_total, dtype=np.int64))
        return pa.table(
            [own.column("doc_id"), own.column("held_out"), pa.array(n_tokens), pa.array(n_known), total, pa.array(logs - n_tokens * base), pa.array(score)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


def score(df: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", range_tokens: int = RANGE_TOKENS, hot: int = HOT, bits: int = BITS) -> DataFrame:
    """One row per row of df; the model learns from the rows that are not held out."""
    source = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts, lexicon = learn_words(source, range_tokens, hot)
    shared = df.sparkSession.sparkContext.broadcast(lexicon)
    pieces = source.mapInArrow(_pieces(shared), PIECE)
    if lexicon.begin_parts > 1 or (lexicon.parts > 1).any():
        summed = source.select("held_out", "text").mapInArrow(_hot_pairs(shared), "v long, w long, c long").groupBy("v", "w").agg(F.sum("c").alias("c"))
        pieces = pieces.unionByName(summed.mapInArrow(_pairs_to_ranges(shared), PIECE))
    asked = source.select("text").mapInArrow(_asked(shared), "range int, key long")
    # joined before repeated rows go: both need the rows of a key together; words that occur once are not looked up
    found = asked.join(counts.filter("m > 1").select("key", "c"), "key").select("range", "key", "c").distinct()
    answers = pieces.groupBy("range").cogroup(found.groupBy("range")).applyInArrow(_answers(shared, bits), "block long, row binary, score binary, rare_row binary, rare_c binary, own binary")
    kind = dict(source.dtypes)["doc_id"]
    return answers.groupBy("block").applyInArrow(
        _put_together(lexicon.total, lexicon.distinct),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
