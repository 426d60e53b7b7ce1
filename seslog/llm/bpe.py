"""BPE encoding and decoding; long unsplit text is encoded in pieces that are concatenated in a tree.

A text of up to `long_chars` characters is encoded as it is. A longer one is cut into at most 64 pieces, which Spark
deals out over the cluster; its pieces are then joined two and two. A cut between a letter and a space before a letter
is always a cut between words of the pattern, so tokens on both sides stand. Where a stretch has no such place, the cut
is made anywhere, and the join repairs it:

1. word starts of the left side are right up to three characters before its end (no alternative of the pattern looks
   further), so splitting goes on from there until a start falls on a word start of the right side;
2. a short word across the cut is encoded anew; in a long one a window of tokens around the cut is encoded and doubled
   until its first token is the left side's and its last token the right side's. In BPE by ranks a token sequence is the
   encoding of its text exactly if each two neighbours are that of theirs; both ends agree, so all neighbours are.

Defined cases: a null text is encoded as the empty text (no ids). Rows may repeat and ids may be null: pieces belong to
a text, not to a row, so copies of a long text are encoded once. Other columns, whatever their names, are kept.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seslog.llm.arrowtext import blocks
from seslog.llm.common import fresh_name, spread
from seslog.llm.vocabulary import Vocabulary, load

LONG_CHARS = 1 << 16
MOST_PIECES = 64
SHORT_WORD = 1 << 12
IDS = pa.list_(pa.int32())


# --- pieces and their joins -------------------------------------------------------------------------------------------
def _safe_cut(text: str, low: int, high: int) -> int:
    """The last place in low..high between a letter and a space before a letter, or -1."""
    at = text.rfind(" ", low, high)
    while at > low:
        if text[at - 1].isalpha() and text[at + 1 : at + 2].isalpha():
            return at
        at = text.rfind(" ", low, at)
    return -1


def cut(text: str, special: dict[str, int], size: int) -> list[tuple[str, bool]]:
    """Pieces of about `size` characters; the flag says that the piece is glued to the one before (no safe place)."""
    inner, parts, at = max(size, len(text) // MOST_PIECES + 1), [], 0
    glued = False
    while len(text) - at > inner:
        stop = _safe_cut(text, at + inner // 2, at + inner)
        safe = stop > 0
        stop = stop if safe else at + inner
        for name in special:  # never cut a special token's string
            hit = text.find(name, max(at, stop - len(name) + 1), stop + len(name) - 1)
            if 0 <= hit < stop < hit + len(name):
                stop, safe = hit + len(name), True
        parts.append((text[at:stop], glued))
        at, glued = stop, not safe
    parts.append((text[at:], glued))
    return parts


class Piece:
    """An encoded text: its ids, and for each word of the pattern its start and its first token."""

    def __init__(self, text: str, ids: list[int], starts: list[int], tokens: list[int]):
        self.text, self.ids, self.starts, self.tokens = text, ids, starts, tokens


def encode_piece(vocabulary: Vocabulary, text: str) -> Piece:
    """Word by word, with special tokens' strings as words of their own."""
    ids: list[int] = []
    starts: list[int] = []
    tokens: list[int] = []
    at = 0
    while at < len(text):
        hits = [(p, s) for s in vocabulary.special if (p := text.find(s, at)) >= 0]
        stop, name = min(hits, default=(len(text), ""))
        words = vocabulary.word_starts(text[at:stop]) if stop > at else []
        for a, b in zip(words, [*words[1:], stop - at]):
            starts.append(at + a)
            tokens.append(len(ids))
            ids += vocabulary.encode_word(text[at + a : at + b].encode())
        if name:
            starts.append(stop)
            tokens.append(len(ids))
            ids.append(vocabulary.special[name])
        at = stop + len(name)
    return Piece(text, ids, starts, tokens)


def _join_word(vocabulary: Vocabulary, left: list[int], right: list[int]) -> list[int]:
    """Tokens of one long word from those of its two parts: windows around the cut, doubled until both sides agree."""
    k, names = 8, vocabulary.bytes_of
    while k < len(left) and k < len(right):
        window = vocabulary.encode_word(b"".join(names[i] for i in [*left[-k:], *right[:k]]))
        if window[0] == left[-k] and window[-1] == right[k - 1]:
            return left[:-k] + window + right[k:]
        k *= 2
    return vocabulary.encode_word(b"".join(names[i] for i in [*left, *right]))


def _part(piece: Piece, low: int, high: int) -> Piece:
    """The part between two places at which words start (or the text ends)."""
    i, j = bisect_left(piece.starts, low), bisect_left(piece.starts, high)
    first = piece.tokens[i] if i < len(piece.tokens) else len(piece.ids)
    last = piece.tokens[j] if j < len(piece.tokens) else len(piece.ids)
    return Piece(piece.text[low:high], piece.ids[first:last], [s - low for s in piece.starts[i:j]], [t - first for t in piece.tokens[i:j]])


def _beside(left: Piece, right: Piece) -> Piece:
    edge, shift = len(left.text), len(left.ids)
    return Piece(left.text + right.text, left.ids + right.ids, left.starts + [s + edge for s in right.starts], left.tokens + [t + shift for t in right.tokens])


def join(vocabulary: Vocabulary, left: Piece, right: Piece) -> Piece:
    """The encoding of left.text + right.text. Special tokens' strings end all words, so only what is between them is joined."""
    low = max((p + len(s) for s in vocabulary.special if (p := left.text.rfind(s)) >= 0), default=0)
    high = min((p for s in vocabulary.special if (p := right.text.find(s)) >= 0), default=len(right.text))
    middle = _join_plain(vocabulary, _part(left, low, len(left.text)), _part(right, 0, high))
    return _beside(_beside(_part(left, 0, low), middle), _part(right, high, len(right.text)))


def _join_plain(vocabulary: Vocabulary, left: Piece, right: Piece) -> Piece:
    text, edge = left.text + right.text, len(left.text)
    if not left.text or not right.text:
        return left if left.text else right
    known = bisect_left(left.starts, edge - 2) - 1
    if known < 0:
        return encode_piece(vocabulary, text)
    begin, shift = left.starts[known], edge
    reach = 64
    while True:  # split on until a word starts where one of the right side does
        stop = min(edge + reach, len(text))
        found = [begin + s for s in vocabulary.word_starts(text[begin:stop])]
        last = stop if stop == len(text) else stop - 3
        meet = next((s for s in found if s >= edge and s <= last and _at(right.starts, s - shift) >= 0), None)
        if meet is not None or stop == len(text):
            break
        reach *= 4
    cut_right = len(right.starts) if meet is None else _at(right.starts, meet - shift)
    end = len(text) if meet is None else meet
    words = [s for s in found if s < end]
    ids, starts, tokens = left.ids[: left.tokens[known]], left.starts[:known], left.tokens[:known]
    for a, b in zip(words, [*words[1:], end]):
        starts.append(a)
        tokens.append(len(ids))
        whole = a < edge < b and b - a > SHORT_WORD and _at(left.starts, a) == len(left.starts) - 1 and cut_right == 1
        if whole:
            ids += _join_word(vocabulary, left.ids[left.tokens[-1] :], right.ids[: right.tokens[1] if len(right.tokens) > 1 else len(right.ids)])
        else:
            ids += vocabulary.encode_word(text[a:b].encode())
    if cut_right < len(right.starts):
        move = len(ids) - right.tokens[cut_right]
        starts += [s + shift for s in right.starts[cut_right:]]
        tokens += [t + move for t in right.tokens[cut_right:]]
        ids += right.ids[right.tokens[cut_right] :]
    return Piece(text, ids, starts, tokens)


def _at(values: list[int], value: int) -> int:
    i = bisect_left(values, value)
    return i if i < len(values) and values[i] == value else -1


def join_all(vocabulary: Vocabulary, pieces: list[Piece], glued: list[bool]) -> list[int]:
    """Glued runs are joined as a tree of halves; other neighbours are only put one after the other."""
    ids: list[int] = []
    at = 0
    while at < len(pieces):
        stop = at + 1
        while stop < len(pieces) and glued[stop]:
            stop += 1
        level = pieces[at:stop]
        while len(level) > 1:
            level = [join(vocabulary, *level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        ids += level[0].ids
        at = stop
    return ids


# --- over DataFrames --------------------------------------------------------------------------------------------------
def _encode_short(path: str, text: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path)
        for batch in blocks(batches, text, 1 << 21):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            ids = [vocabulary.encode_array(t or "") for t in texts]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            yield batch.append_column(out, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32))))

    return run


def _pieces(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = load(path).special
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for no, (part, glued) in enumerate(cut(text, special, size)):
                    yield pa.RecordBatch.from_pydict({"key": [key], "no": pa.array([no], pa.int32()), "glued": [glued], "part": [part]})

    return run


def _encode_pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path)
        for batch in batches:
            for row in batch.to_pylist():
                piece = encode_piece(vocabulary, row["part"])
                yield pa.RecordBatch.from_pydict(
                    {
                        **{k: [row[k]] for k in ("key", "glued", "part")},
                        "no": pa.array([row["no"]], pa.int32()),
                        **{k: pa.array([v], IDS) for k, v in (("ids", piece.ids), ("starts", piece.starts), ("tokens", piece.tokens))},
                    }
                )

    return run


def _assemble(path: str):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("no")
        vocabulary = load(path)
        pieces = [Piece(r["part"], r["ids"], r["starts"], r["tokens"]) for r in rows.select(["part", "ids", "starts", "tokens"]).to_pylist()]
        ids = join_all(vocabulary, pieces, rows.column("glued").to_pylist())
        return pa.table({"key": rows.column("key").slice(0, 1), "long_ids": pa.array([ids], IDS)})

    return run


def encode_long(texts: DataFrame, path: str, piece_chars: int) -> DataFrame:
    """(key, part text) of distinct long texts -> (key, long_ids). One group holds the pieces of one text."""
    parts = texts.mapInArrow(_pieces(path, piece_chars), "key string, no int, glued boolean, part string")
    encoded = spread(parts, "key", "no").mapInArrow(
        _encode_pieces(path), "key string, glued boolean, part string, no int, ids array<int>, starts array<int>, tokens array<int>"
    )
    return encoded.groupBy("key").applyInArrow(_assemble(path), "key string, long_ids array<int>")


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids", long_chars: int = LONG_CHARS) -> DataFrame:
    """df with a column `out`: the ids of its texts as the vocabulary file at `path` gives them."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    # the few long texts are known by their digest; nothing else of them is shuffled
    is_long = F.length(text) > long_chars
    short = df.filter(F.coalesce(~is_long, F.lit(True))).mapInArrow(_encode_short(path, text, out), schema)
    key, many = fresh_name(df, "text_key"), df.filter(is_long)
    distinct = many.select(F.sha2(text, 256).alias("key"), F.col(text).alias("part")).dropDuplicates(["key"])
    ids = encode_long(distinct, path, max(long_chars // 4, 1))
    found = many.withColumn(key, F.sha2(text, 256)).join(ids.withColumnsRenamed({"key": key, "long_ids": out}), key).select(*df.columns, out)
    return short.unionByName(found)


def id_rows(ids: pa.Array) -> Iterator[np.ndarray | None]:
    """The ids of each row, one row at a time: a batch as Python integers would take ten times the room. Nulls within a row are left out."""
    for row in ids:
        yield row.values.drop_null().to_numpy() if row.is_valid else None


def decoder(path: str):
    """A function of an id column: its text, as the vocabulary's decoder gives it with special tokens kept."""

    @F.arrow_udf(T.StringType())
    def decode(ids: pa.Array) -> pa.Array:
        vocabulary = load(path)
        return pa.array((None if x is None else vocabulary.decode(x) for x in id_rows(ids)), pa.string())

    return decode


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with a column `out`: the text of its ids. Null ids give null; bytes that are not UTF-8 give U+FFFD."""
    return df.withColumn(out, decoder(path)(F.col(ids)))
