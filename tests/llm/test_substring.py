"""Substring dedup against a count of all windows, and its FM-index against plain search."""

import collections
import random
import re

import numpy as np
import pytest

from seslog.llm import substring
from seslog.llm.fmindex import Bits, FMIndex, WaveletMatrix, suffix_array

SCHEMA = "doc_id long, text string, row long, mask string, TEXT_ int"


def brute(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def rows():
    r = random.Random(8)
    word = lambda: "w" + str(r.randint(0, 400))
    passage = [word() for _ in range(80)]
    texts = []
    for i in range(150):
        own = [word() for _ in range(r.randint(0, 120))]
        if i % 3 == 0:  # a third of all rows share a passage, with other words around it
            cut = r.randint(0, 20)
            own[len(own) // 2 : len(own) // 2] = passage[cut : len(passage) - r.randint(0, 20)]
        texts.append(r.choice([" ", "\n", " \t"]).join(own))
    texts += [texts[5]] * 6 + [texts[3] + " end"] + ["a b " * 60, "x " * 100, "a b " * 30, None, "", " \n\t", "é 中 " * 40, "word", " ".join(passage[:35]), " ".join(passage[:34])]
    texts += ["\x1c".join(["u"] * 50), "x " * 90, "W w " * 20 + "w W " * 20, " ".join(word() for _ in range(30_000))]
    return [(i if i % 11 else None, t, i, "kept", 5) for i, t in enumerate(texts)]


@pytest.mark.parametrize("window, options", [(35, {}), (35, {"class_segments": 3, "shard_words": 500, "frequent": 1}), (35, {"class_segments": 0, "frequent": 20}), (5, {"shard_words": 3000}), (1, {"class_segments": 20}), (60, {})])
def test_equals_the_count_of_all_windows(spark, window, options):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = substring.cut_repeats(df, window=window, **options)
    assert got.columns == ["doc_id", "row", "mask", "TEXT_", "cut"]
    assert sorted((r.row, *r.cut) for r in got.collect()) == sorted((r[2], *b) for r, b in zip(rows(), brute([r[1] for r in rows()], window)))


def test_empty_table(spark):
    assert substring.cut_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_index_finds_what_a_plain_search_finds():
    r = np.random.default_rng(3)
    for _ in range(60):
        size = int(r.integers(2, 9))
        texts = [r.integers(1, size, int(r.integers(1, 30))).tolist() for _ in range(int(r.integers(1, 8)))]
        twice = r.integers(0, 2, len(texts)).tolist()
        stream = np.array([x for t in texts for x in [*t, 0]])
        index = FMIndex(stream, size, np.repeat(twice, [len(t) + 1 for t in texts]))
        count = lambda p: sum((1 + m) * sum(t[i : i + len(p)] == p for i in range(len(t))) for t, m in zip(texts, twice))
        ends = np.flatnonzero(stream)
        lengths = index.matching_statistics(stream, ends, 6)
        for end, length in zip(ends, lengths):
            before = []
            while end - len(before) >= 0 and stream[end - len(before)] and len(before) < 6 and count([int(stream[end - len(before)]), *before]) > 1:
                before.insert(0, int(stream[end - len(before)]))
            assert length == len(before)


def test_open_windows_are_asked_until_none_is_left(monkeypatch):
    """Equal to the count of all windows; a copy of all of a segment takes one question, not one for each window."""
    asked = []
    real = FMIndex.matching_statistics
    monkeypatch.setattr(FMIndex, "matching_statistics", lambda self, stream, ends, longest: asked.append(len(ends)) or real(self, stream, ends, longest))
    r = np.random.default_rng(11)
    for window, size in ((1, 3), (2, 4), (4, 3), (6, 3)):
        for _ in range(40):
            base = r.integers(1, size, 60)
            texts = []
            for _ in range(int(r.integers(1, 9))):
                text = base[int(r.integers(0, 30)) :][: int(r.integers(window, window + 24))].copy()
                text[r.random(len(text)) < 0.1] = r.integers(1, 9)
                texts.append(text.tolist())
            twice = r.random(len(texts)) < 0.2
            stream = np.array([x for t in texts for x in [*t, 0]])
            index = FMIndex(stream, 10, np.repeat(twice, [len(t) + 1 for t in texts]))
            begin = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
            windows = np.array([len(t) - window + 1 for t in texts])
            seen = collections.Counter()
            for t, more in zip(texts, twice):
                for i in range(len(t) - window + 1):
                    seen[tuple(t[i : i + window])] += 1 + int(more)
            want = [sum(1 << i for i in range(len(t) - window + 1) if seen[tuple(t[i : i + window])] > 1) for t in texts]
            assert substring.repeated_masks(index, stream, begin, windows, window).tolist() == want
    asked.clear()
    stream = np.array([*range(1, 59), 0])
    index = FMIndex(stream, 59, np.ones(59, dtype=bool))
    assert substring.repeated_masks(index, stream, np.array([0]), np.array([24]), 35).tolist() == [(1 << 24) - 1] and asked == [1]


def test_ranks_and_suffixes():
    r = np.random.default_rng(5)
    values = r.integers(0, 77, 1000)
    matrix, at = WaveletMatrix(values, 77), np.arange(1001)
    for v in (0, 1, 40, 76):
        assert matrix.rank(np.full(1001, v), at).tolist() == np.append(0, np.cumsum(values == v)).tolist()
    assert Bits(values % 2).rank(at).tolist() == np.append(0, np.cumsum(values % 2)).tolist()
    stream = np.append(r.integers(0, 3, 300), 0)
    own = [(-1000 + int((stream[:i] == 0).sum()) if x == 0 else int(x)) for i, x in enumerate(stream)]
    assert suffix_array(stream).tolist() == sorted(range(len(own)), key=lambda i: own[i:])
