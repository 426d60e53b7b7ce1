"""Cross-tokenizer alignment against a plain walk over both lists of ends."""

import collections
import hashlib
import random

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from seslog.llm import align

A, B = align.default_paths()
SCHEMA = "doc_id long, text string, row string, pairs int, N_A int"


def brute(texts):
    """The numbers of each text, from lists of (A ids, B ids) of each group."""
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    letters = {x: bytes([i]) for x, i in align.vocabulary._byte_of_letter().items()}
    s = sentencepiece.SentencePieceProcessor(model_file=B)
    found = []
    for text in texts:
        e = t.encode(" " + (text or ""), add_special_tokens=False) if text else None
        b = s.encode(text) if text else []
        bytes_a = [b"".join(letters[c] for c in x) for x in e.tokens] if text else []
        names = [s.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if s.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, names)]
        whole = (" " + (text or "")).encode()
        groups = []
        if text and b"".join(bytes_a) == whole and b"".join(bytes_b) == whole:
            ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
            i = j = 0
            for end in sorted(set(ends_a) & set(ends_b)):
                p, q = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
                groups.append((e.ids[i:p], b[j:q]))
                i, j = p, q
        found.append(groups)
    holds = collections.Counter(pair for groups in found for pair in {(a, b) for x, y in groups for a in x for b in y})
    best = collections.defaultdict(int)
    for (a, _), n in holds.items():
        best[a] = max(best[a], n)
    out = []
    for groups in found:
        links = [(a, b) for x, y in groups for a in x for b in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(holds[p] == best[p[0]] for p in links), sum(holds[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def rows():
    r = random.Random(2)
    parts = ["the", " ", "  ", "\n", "tion", "ing", "Straße", "é", "中文", "😀", "\t", "\0", "<s>", "<|endoftext|>", "▁", "1234", "don't", "x" * 9, "　", "①"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 80))) for _ in range(120)]
    texts += [None, "", " ", "plain words here", "plain words here", "a" * 3000, "ab " * 900, "▁", "▁ x", "中" * 700, "the quick brown fox " * 200]
    return [(i if i % 17 else None, t, "kept", i, 7) for i, t in enumerate(texts)]


def values(df):
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((r["pairs"], tuple(r["alignment"][c] for c in names)) for r in df.collect())


def test_equals_the_plain_walk(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    want = sorted(zip([r[3] for r in rows()], brute([r[1] for r in rows()])))
    assert values(align.align(df)) == want
    # long texts dealt out in pieces, no pair frequent; and all of them frequent
    got = align.align(df, long_chars=100, steps=7, frequent=1)
    assert values(got) == want
    assert got.columns == ["doc_id", "row", "pairs", "N_A", "alignment"] and {(r.row, r.N_A) for r in got.collect()} == {("kept", 7)}
    assert values(align.align(df, long_chars=500, steps=1, frequent=1 << 30)) == want


def test_empty_table(spark):
    assert align.align(spark.createDataFrame([], SCHEMA)).count() == 0


def test_merges_of_any_piece_size():
    r = np.random.default_rng(1)
    for _ in range(200):
        end = int(r.integers(1, 60))
        a, b = (np.unique([*r.integers(1, end + 1, int(r.integers(0, 40))), end]) for _ in range(2))
        want = sorted(set(a.tolist()) & set(b.tolist()))
        for steps in (1, 2, 3, 7, 100):
            close_a, close_b = align.closings(a, b, steps)
            assert a[close_a - 1].tolist() == want and b[close_b - 1].tolist() == want
            assert all(len(x) + len(y) <= steps for x, y in align.piece_rows(a, b, steps))


def test_crowded_groups_are_multiplied_by_distinct_ids(monkeypatch):
    r = np.random.default_rng(4)
    a, b = r.integers(0, 9, 400).astype(np.int32), r.integers(0, 7, 300).astype(np.int32)
    close_a, close_b, row = np.array([5, 150, 151, 400]), np.array([1, 120, 200, 300]), np.array([0, 0, 1, 1])
    want = align.linked(a, b, close_a, close_b, row, 7, 63)
    assert want[1].sum() == 5 + 145 * 119 + 80 + 249 * 100
    for most in (1, 100, 10_000):
        monkeypatch.setattr(align, "LINKS_AT_ONCE", most)
        for x, y in zip(align.linked(a, b, close_a, close_b, row, 7, 63), want):
            assert x.tolist() == y.tolist()
