"""Cross-tokenizer alignment by merge-path partitioning.

Two tokenizers cut one byte string; the byte offsets at which both end a token cut its tokens into groups. The ends of
the A tokens and of the B tokens are two increasing lists. Merging them is divided by diagonals: diagonal d holds the
ways to have merged d ends, and a binary search on it finds how many of them are A's, so that pieces of equally many
steps are merged independently of each other. A piece gives the steps at which both tokens end together; where a
diagonal falls between the two ends of one offset, the last A end of a piece and the first B end of the next are
compared when the pieces are stitched.

Short texts are encoded, merged and stitched block by block in one task (a block is a few MB of texts laid end to end;
every text's end is an offset of both). A text of more than `long_chars` characters is dealt out: its pieces are rows
of their own, and only their closing steps come back to it.

How many documents hold an id pair linked is counted over all documents. A document's own pairs are distinct, with how
often each is linked, so pairs of occurrences are never written down; a crowded group is multiplied by its distinct ids.
Pairs that make up more than a share of all are at most 1 / share many: their counts are broadcast. The others meet
their counts by a join in which no key has more rows than that share.

Defined cases: a document is a row, so equal rows count each; ids may repeat or be null. A text that is null or empty, or
that either tokenizer does not give back byte by byte, has no tokens: all numbers 0, an empty digest, no pairs. Strings of
special tokens are ordinary text. An empty table gives an empty table. Other columns, whatever their names, are kept.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seslog.llm import vocabulary
from seslog.llm.arrowtext import blocks
from seslog.llm.common import spread, stage

LONG_CHARS = 1 << 16
PIECE_STEPS = 1 << 15
BLOCK_BYTES = 1 << 21
LINKS_AT_ONCE = 1 << 21
FREQUENT = 1 << 16  # pairs above this share of all (document, pair) rows are broadcast: at most so many
PIECE_FILE = "piece_bpe_32k.model"
IDS = pa.list_(pa.int32())
LONGS = pa.list_(pa.int64())
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
FOUND = [(c, pa.int64()) for c in NUMBERS] + [("groups_sha256", pa.string()), ("pairs", LONGS), ("times", IDS)]
FOUND_TYPES = [T.StructField(c, T.LongType()) for c in NUMBERS] + [
    T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))
]


# --- the two tokenizers ------------------------------------------------------------------------------------------------
def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return vocabulary.default_path(), str(public_tokenizers.path(PIECE_FILE))


class Both:
    """Byte-level vocabulary A on space + text, pieces B on the text; their token bytes, lengths and written ids."""

    def __init__(self, path_a: str, path_b: str):
        self.a = vocabulary.load(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = self.a.bytes_of
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.get_piece_size()) for p in (self.b.id_to_piece(i),)]
        self.length_a, self.length_b = (np.array([len(x) for x in table], dtype=np.int64) for table in (self.bytes_a, self.bytes_b))
        self.inner = np.array([f"{i}," for i in range(max(len(self.bytes_a), len(self.bytes_b)))], dtype=object)
        self.last_a, self.last_b = (np.array([f"{i}{end}" for i in range(len(table))], dtype=object) for table, end in ((self.bytes_a, "|"), (self.bytes_b, ";")))

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both; none for a text without bytes or one that is not given back byte by byte."""
        rows_a, rows_b = [], []
        for text, b in zip(texts, self.b.encode([t or "" for t in texts], num_threads=1)):
            whole = f" {text}".encode()
            a = self.a.encoding.encode_to_numpy(f" {text}", disallowed_special=()) if text else []
            given = text and b"".join([self.bytes_a[i] for i in a.tolist()]) == whole and b"".join([self.bytes_b[i] for i in b]) == whole
            rows_a.append(np.asarray(a if given else [], dtype=np.int32))
            rows_b.append(np.asarray(b if given else [], dtype=np.int32))
        return rows_a, rows_b


@functools.lru_cache(maxsize=2)
def load(path_a: str, path_b: str) -> Both:
    return Both(path_a, path_b)


# --- merging two lists of ends -----------------------------------------------------------------------------------------
def diagonals(a: np.ndarray, b: np.ndarray, steps: int) -> list[tuple[int, int]]:
    """How many of A's and of B's ends lie before each cut, every `steps` steps of their merge (A first where they tie)."""
    d = np.arange(0, len(a) + len(b), steps, dtype=np.int64)
    low, high = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        right = open_.copy()
        right[open_] = a[middle[open_]] <= b[(d - middle - 1)[open_]]
        low, high = np.where(right, middle + 1, low), np.where(open_ & ~right, middle, high)
    return [*zip(low.tolist(), (d - low).tolist()), (len(a), len(b))]


def merge_piece(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many A and B ends there are up to each step of the piece at which both end."""
    if not len(a) or not len(b):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.searchsorted(b, a)
    both = np.flatnonzero(b[np.minimum(at, len(b) - 1)] == a)
    return both + 1, at[both] + 1


def stitch(pieces: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces in order, each (A ends, B ends, closings of A, of B, last A end, first B end): the closings of the whole."""
    all_a, all_b, seen_a, seen_b, before = [], [], 0, 0, None
    for n_a, n_b, close_a, close_b, last_a, first_b in pieces:
        if n_b and before is not None and before == first_b:  # the diagonal fell between two equal ends
            all_a.append([seen_a])
            all_b.append([seen_b + 1])
        all_a.append(np.asarray(close_a) + seen_a)
        all_b.append(np.asarray(close_b) + seen_b)
        seen_a, seen_b = seen_a + n_a, seen_b + n_b
        before = last_a if n_a else before
    return tuple(np.concatenate([np.zeros(0, dtype=np.int64), *x]).astype(np.int64) for x in (all_a, all_b))


def piece_rows(a: np.ndarray, b: np.ndarray, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    cuts = diagonals(a, b, steps)
    for (i, j), (k, m) in zip(cuts, cuts[1:]):
        yield a[i:k], b[j:m]


def closings(a: np.ndarray, b: np.ndarray, steps: int = PIECE_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """How many A and B tokens there are up to each offset at which both end."""
    return stitch([(len(x), len(y), *merge_piece(x, y), x[-1] if len(x) else None, y[0] if len(y) else None) for x, y in piece_rows(a, b, steps)])


# --- groups, links and digests -----------------------------------------------------------------------------------------
def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(inverse, np.concatenate(times), len(key)).astype(np.int64)


def linked(a: np.ndarray, b: np.ndarray, close_a: np.ndarray, close_b: np.ndarray, row: np.ndarray, size_b: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys (row * cells + A id * size_b + B id) of all links, and how often each is linked."""
    from_a, from_b = close_a - np.diff(close_a, prepend=0), close_b - np.diff(close_b, prepend=0)
    n_a, n_b = close_a - from_a, close_b - from_b
    links = n_a * n_b
    keys, times = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for g in np.flatnonzero(links > LINKS_AT_ONCE):  # crowded: distinct ids of one side against those of the other
        ids_a, count_a = np.unique(a[from_a[g] : close_a[g]].astype(np.int64), return_counts=True)
        ids_b, count_b = np.unique(b[from_b[g] : close_b[g]].astype(np.int64), return_counts=True)
        for i, n in zip(ids_a, count_a):
            keys.append(row[g] * cells + i * size_b + ids_b)
            times.append(n * count_b)
    few = np.flatnonzero(links <= LINKS_AT_ONCE)
    upto = np.cumsum(links[few])
    at = 0
    while at < len(few):
        stop = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LINKS_AT_ONCE, side="right")), at + 1)
        some = few[at:stop]
        group = np.repeat(some, links[some])
        k = np.arange(len(group)) - np.repeat(np.cumsum(links[some]) - links[some], links[some])
        i, j = from_a[group] + k // n_b[group], from_b[group] + k % n_b[group]
        key, n = np.unique(row[group] * cells + a[i].astype(np.int64) * size_b + b[j], return_counts=True)
        keys.append(key)
        times.append(n)
        at = stop
    return _summed(keys, times) if len(keys) > 2 else (keys[-1], times[-1])


def describe(both: Both, rows_a: list[np.ndarray], rows_b: list[np.ndarray], close_a: np.ndarray, close_b: np.ndarray) -> list[pa.Array]:
    """The columns of FOUND for texts laid end to end; each text's end is a closing."""
    n_a, n_b = np.array([len(x) for x in rows_a], dtype=np.int64), np.array([len(x) for x in rows_b], dtype=np.int64)
    a, b = (np.concatenate([np.zeros(0, dtype=np.int32), *x]) for x in (rows_a, rows_b))
    ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
    row = np.searchsorted(ends_a, close_a)  # the first text that reaches so far: texts without tokens have no closing
    sizes_a, sizes_b = np.diff(close_a, prepend=0), np.diff(close_b, prepend=0)
    n_groups = np.bincount(row, minlength=len(n_a))
    n_links = np.zeros(len(n_a), dtype=np.int64)
    np.add.at(n_links, row, sizes_a * sizes_b)
    # written ids: A's of a group, then B's; the last of each with its own mark
    written = np.empty(len(a) + len(b), dtype=object)
    place_a = np.arange(len(a)) + np.repeat(close_b - sizes_b, sizes_a)
    place_b = np.arange(len(b)) + np.repeat(close_a, sizes_b)
    written[place_a], written[place_b] = both.inner[a], both.inner[b]
    written[place_a[close_a - 1]], written[place_b[close_b - 1]] = both.last_a[a[close_a - 1]], both.last_b[b[close_b - 1]]
    bounds = np.concatenate(([0], ends_a + ends_b))
    digests = [hashlib.sha256("".join(written[x:y].tolist())[:-1].encode()).hexdigest() if y > x else "" for x, y in zip(bounds, bounds[1:])]
    size_b = len(both.bytes_b)
    cells = len(both.bytes_a) * size_b
    key, times = linked(a, b, close_a, close_b, row, size_b, cells)
    offsets = pa.array(np.searchsorted(key, np.arange(len(n_a) + 1) * cells).astype(np.int32))
    numbers = [pa.array(x.astype(np.int64)) for x in (n_a, n_b, n_groups, n_links)]
    return [*numbers, pa.array(digests), pa.ListArray.from_arrays(offsets, pa.array(key % cells)), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))]


# --- over DataFrames ---------------------------------------------------------------------------------------------------
def _align_short(paths: tuple[str, str], text: str, steps: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = load(*paths)
        for batch in blocks(batches, text, BLOCK_BYTES):
            rows_a, rows_b = both.encode(batch.column(batch.schema.get_field_index(text)).to_pylist())
            a, b = (np.cumsum(lengths[np.concatenate(rows)]) for lengths, rows in ((both.length_a, rows_a), (both.length_b, rows_b)))
            columns = describe(both, rows_a, rows_b, *closings(a, b, steps))
            keep = [i for i, c in enumerate(batch.schema.names) if c != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *columns], [*(batch.schema.names[i] for i in keep), *(c for c, _ in FOUND)])

    return run


def _encode_long(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = load(*paths)
        for batch in blocks(batches, "text", 1):
            (a,), (b,) = both.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a], IDS), pa.array([b], IDS)], ["row", "a", "b"])

    return run


def _cut_pieces(paths: tuple[str, str], steps: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = load(*paths)
        for batch in batches:
            for row, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                ends = (np.cumsum(lengths[ids.values.to_numpy()]) for lengths, ids in ((both.length_a, a), (both.length_b, b)))
                for no, (x, y) in enumerate(piece_rows(*ends, steps)):
                    yield pa.RecordBatch.from_pydict({"row": [row], "no": pa.array([no], pa.int32()), "a": pa.array([x], LONGS), "b": pa.array([y], LONGS)})

    return run


PIECE = "row long, no int, n_a long, n_b long, close_a array<long>, close_b array<long>, last_a long, first_b long"


def _merge_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            a, b = (batch.column(k)[i].values.to_numpy() for k in (2, 3))
            close_a, close_b = merge_piece(a, b)
            ends = [pa.array([int(x[at])] if len(x) else [None], pa.int64()) for x, at in ((a, -1), (b, 0))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([len(a)]), pa.array([len(b)]), pa.array([close_a], LONGS), pa.array([close_b], LONGS), *ends],
                ["row", "no", "n_a", "n_b", "close_a", "close_b", "last_a", "first_b"],
            )


def _stitch_pieces(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("no")
    close = stitch([tuple(r.values()) for r in rows.select(["n_a", "n_b", "close_a", "close_b", "last_a", "first_b"]).to_pylist()])
    return pa.table({"row": rows.column("row").slice(0, 1), "close_a": pa.array([close[0]], LONGS), "close_b": pa.array([close[1]], LONGS)})


def _describe_long(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = load(*paths)
        for batch in batches:
            for i in range(batch.num_rows):
                a, b, close_a, close_b = (batch.column(k)[i].values.to_numpy() if batch.column(k)[i].is_valid else np.zeros(0, dtype=np.int64) for k in (1, 2, 3, 4))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *describe(both, [a], [b], close_a, close_b)], ["row", *(c for c, _ in FOUND)])

    return run


def _long_texts(texts: DataFrame, paths: tuple[str, str], steps: int) -> DataFrame:
    """(row, text) -> row and the columns of FOUND; merged piece by piece, each piece a row of its own."""
    encoded = stage(spread(texts, "row").mapInArrow(_encode_long(paths), "row long, a array<int>, b array<int>"))
    pieces = encoded.mapInArrow(_cut_pieces(paths, steps), "row long, no int, a array<long>, b array<long>")
    merged = spread(pieces, "row", "no").mapInArrow(_merge_pieces, PIECE)
    close = merged.groupBy("row").applyInArrow(_stitch_pieces, "row long, close_a array<long>, close_b array<long>")
    whole = encoded.join(close, "row", "left").select("row", "a", "b", "close_a", "close_b")
    return whole.mapInArrow(_describe_long(paths), T.StructType([T.StructField("row", T.LongType()), *FOUND_TYPES]))


def _links(found: DataFrame) -> DataFrame:
    return found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """(pair, count, best): the documents that hold a pair linked, and whether no pair of its A id has more."""
    counts = stage(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count")))
    a = F.floor(F.col("pair") / size_b).cast("long")
    most = counts.groupBy(a.alias("a")).agg(F.max("count").alias("most"))  # no more rows than A has ids
    return stage(counts.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best")))


def _sums(found: DataFrame, numbers: DataFrame, frequent: int) -> DataFrame:
    """(row, n_best, count_sum): each row's links with the counts of their pairs."""
    total = numbers.agg(F.sum("count")).first()[0] or 0
    often = F.broadcast(numbers.filter(F.col("count") * frequent > total))  # fewer than `frequent` rows
    links = _links(found)
    known = links.join(often, "pair")
    others = links.join(often.select("pair"), "pair", "left_anti").join(numbers.filter(F.col("count") * frequent <= total), "pair")
    both = known.select("row", "times", "count", "best").union(others.select("row", "times", "count", "best"))
    return both.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))


def align(
    df: DataFrame, paths: tuple[str, str] | None = None, text: str = "text", long_chars: int = LONG_CHARS, steps: int = PIECE_STEPS, frequent: int = FREQUENT, out: str = "alignment"
) -> DataFrame:
    """df without its texts and with a struct column `out` (an older one of that name is replaced).

    Its fields: n_a, n_b, n_groups, n_links, groups_sha256, pairs (A id * number of B ids + B id) and times (how often
    each is linked), n_best and count_sum.
    """
    paths = paths or default_paths()
    inner = {c: f"c{i}" for i, c in enumerate(df.columns) if c not in (text, out)}
    # rows are numbered where they are written, long ones oddly, so a number stays with its row when a task is run again
    plain = df.select(F.col(text).alias("text"), *[F.col(c).alias(k) for c, k in inner.items()])
    is_long = F.coalesce(F.length("text") > long_chars, F.lit(False))
    number = F.monotonically_increasing_id() * 2
    short = plain.filter(~is_long).select(number.alias("row"), "text", *inner.values())
    kept = [f for f in short.schema.fields if f.name != "text"]
    found = short.mapInArrow(_align_short(paths, "text", steps), T.StructType([*kept, *FOUND_TYPES]))
    many = stage(plain.filter(is_long).select((number + 1).alias("row"), "text", *inner.values()))
    dealt = many.drop("text").join(_long_texts(many.select("row", "text"), paths, steps), "row")
    found = stage(found.unionByName(dealt))
    sums = _sums(found, pair_counts(found, len(load(*paths).bytes_b)), frequent)
    whole = found.join(sums, "row", "left")
    fields = [F.col(c) for c, _ in FOUND] + [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return whole.select(*[F.col(k).alias(c) for c, k in inner.items()], F.struct(*fields).alias(out))
