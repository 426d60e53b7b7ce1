"""Language ID: blended-spectrum presence kernels, Nystroem landmarks and one-versus-rest kernel ridge regression.

A text's letters (A-Z lower-cased, all non-ASCII bytes; anything else is a blank) give its byte n-grams for n = 1, 2, 3.
Only their presence counts. The kernel of two texts is the mean over n of the cosine of their presence vectors, whose
n-grams above n = 1 are hashed into a fixed number of places. Training solves ridge regression on the kernel between a sample and
its landmarks; scoring is two matrix products per batch of texts. The text alone decides a prediction.

The sample is bounded: at most `SAMPLE` labelled rows in all, evenly by language and by a hash of the id; of them at
most `LANDMARKS` are landmarks. Every text is read whole.

Defined cases: a text that is null or has no letter is `und` with score 0, so is every text if nothing was learned; a
null language teaches nothing; rows may repeat; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seslog.llm.arrowtext import text_bytes

SAMPLE, LANDMARKS, RIDGE = 4000, 256, 1e-4
PLACES = {1: 256, 2: 2048, 3: 8192}
WIDTH = sum(PLACES.values())
ROWS, BYTES = 256, 8 << 20

FOLD = np.full(256, 0x20, dtype=np.uint8)
FOLD[0x80:] = np.arange(0x80, 0x100)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # presence vectors, each part of unit length
    weights: np.ndarray


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        _, bounds = text_bytes(batch.column(column))
        while at < batch.num_rows:
            stop = min(at + ROWS, max(int(np.searchsorted(bounds, bounds[at] + BYTES, side="right")) - 1, at + 1), batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop


def presence(column: pa.Array) -> np.ndarray:
    """One row of zeros and ones per text."""
    raw, bounds = text_bytes(column)
    out = np.zeros((len(column), WIDTH), dtype=np.float32)
    folded = FOLD[raw].astype(np.uint32)
    row = np.repeat(np.arange(len(column), dtype=np.int64) * WIDTH, np.diff(bounds))
    flat, code, offset = out.reshape(-1), folded, 0
    for n, places in PLACES.items():
        if n > 1:
            code = code[:-1] * np.uint32(0x01000193) + folded[n - 1 :]
            inside = row[: len(code)] == row[n - 1 :]
            slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - int(places).bit_length() + 1)
            flat[(row[: len(code)] + slot)[inside] + offset] = 1
        else:
            flat[row + code] = 1
        offset += places
    return out


def unit(present: np.ndarray) -> np.ndarray:
    """Each part of each row to unit length, so that a product of two rows is the sum of three cosines."""
    at = 0
    for places in PLACES.values():
        part = present[:, at : at + places]
        part /= np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1))
        at += places
    return present


def _has_letter(column: pa.Array, present: np.ndarray) -> np.ndarray:
    ascii_letter = present[:, 0x61:0x7B].any(axis=1)
    out = ascii_letter.copy()
    for i in np.flatnonzero(~ascii_letter & present[:, 0x80:0x100].any(axis=1)):
        out[i] = any(c.isalpha() for c in column[int(i)].as_py())
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches, 2):
        bits = np.packbits(presence(batch.column(2)).astype(bool), axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b.tobytes() for b in bits], pa.binary())], ["lang", "place", "bits"])


def train(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    """A model from a bounded sample of the rows of df that have a text and a language."""
    labelled = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.xxhash64(doc_id).alias("place"), F.col(text).alias("text"))
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    if not counts:
        return Model([], np.zeros((0, WIDTH), dtype=np.float32), np.zeros((0, 0), dtype=np.float32))
    each = max(1, sample // len(counts))
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, min(1.0, 1.5 * each / n + 20 / n)).otherwise(share)
    position = F.shiftrightunsigned("place", 11) / float(1 << 53)
    rows = labelled.filter(position < share).limit(3 * sample + 40 * len(counts)).mapInArrow(_packed, "lang string, place long, bits binary").collect()
    rows = sorted(rows, key=lambda r: (r.lang, r.place, r.bits))
    by_lang: dict[str, list] = {}
    for r in rows:
        if len(by_lang.setdefault(r.lang, [])) < each:
            by_lang[r.lang].append(r.bits)
    languages = sorted(by_lang)
    bits = np.frombuffer(b"".join(b for k in languages for b in by_lang[k]), dtype=np.uint8).reshape(-1, WIDTH // 8)
    label = np.repeat(np.arange(len(languages)), [len(by_lang[k]) for k in languages])
    count = max(1, landmarks // len(languages))
    chosen = np.concatenate([np.flatnonzero(label == i)[:count] for i in range(len(languages))])
    expand = lambda part: unit(np.unpackbits(part, axis=1).astype(np.float32))
    marks = expand(bits[chosen])
    kernel = np.concatenate([expand(bits[i : i + ROWS]) @ marks.T for i in range(0, len(bits), ROWS)]).astype(np.float64) / len(PLACES)
    target = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    balance = (1.0 / np.bincount(label))[label][:, None] * len(label) / len(languages)
    left = kernel.T @ (balance * kernel) + RIDGE * len(label) * (kernel[chosen] + 1e-3 * np.eye(len(chosen)))
    weights = np.linalg.solve(left, kernel.T @ (balance * target))
    return Model(languages, marks, weights.astype(np.float32))


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        names = np.array([*model.languages, "und"], dtype=object)
        for batch in _slices(batches, 1):
            column = batch.column(1)
            vectors = presence(column)
            best, share = np.full(batch.num_rows, len(model.languages)), np.zeros(batch.num_rows)
            letters = _has_letter(column, vectors)
            if model.languages:
                values = (unit(vectors) @ model.landmarks.T / len(PLACES)) @ model.weights
                chance = np.clip((values + 1) / 2, 1e-6, 1)
                chance /= chance.sum(axis=1, keepdims=True)
                top = values.argmax(axis=1)
                best = np.where(letters, top, best)
                share = np.where(letters, chance[np.arange(len(top)), top], 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(names[best].tolist(), pa.string()), pa.array(share.astype(np.float64))], ["doc_id", *batch.schema.names[2:], "lang_pred", "score"])

    return run


def predict(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each row of df."""
    kind = df.schema[doc_id].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_predict(shared), f"doc_id {kind}, lang_pred string, score double")


def identify(df: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out; doc_id, held_out, lang_pred and score of all."""
    marked = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = train(marked.filter(~F.col("held_out")))
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = marked.schema["doc_id"].dataType.simpleString()
    return marked.select("doc_id", "text", "held_out").mapInArrow(_predict(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
