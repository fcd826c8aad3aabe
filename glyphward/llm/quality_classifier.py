"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A document's features are its words and word pairs, hashed into ``2 ** BITS`` slots, and one slot counts words that
repeat the word before. A slot's value is log(1 + count), scaled to length one; the last slot is the bias. FTRL-proximal with per-coordinate rates trains in one task over at
most ``MOST_TRAINING`` labelled documents, picked by a hash of their ids, so any number of labels costs the same;
the sample's ids are that bound times a few bytes and are broadcast, and only the sample's texts are moved. A score
is the logistic of a sparse dot product with 4 MB of weights, in one pass over the documents.

Edge cases: null and empty texts have only the bias and get its score; labels that are null are not used and of
several labels of an id the largest holds; without any label every score is 0.5; a null id is not held out and has
no label; repeated rows are scored each; an empty table gives an empty result; further columns are kept by
:func:`accepted` and ignored otherwise.
"""

from __future__ import annotations

import zlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import as_text, shared_dir

BITS = 20
#: Labelled documents that training reads at most.
MOST_TRAINING = 12_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.0
FOLDS, HELD_OUT = 3, 1
SAMPLE_GRID = 1 << 24


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % folds


def features(data: bytes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text; the bias is slot ``2 ** bits``."""
    words = data.lower().split()
    hashed = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    first, second = hashed[:-1], hashed[1:]
    pairs = (first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits)
    same = np.full(int((first == second).sum()), (1 << bits) - 1, np.int64)
    slots = np.concatenate([(hashed & np.uint64((1 << bits) - 1)).astype(np.int64), pairs.astype(np.int64), same])
    if not len(slots):
        return np.array([1 << bits]), np.array([1.0])
    slots.sort()
    starts = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
    values = np.log1p(np.diff(np.append(starts, len(slots))))
    values /= np.sqrt(values @ values)
    return np.append(slots[starts], 1 << bits), np.append(values, 1.0)


class Ftrl:
    """FTRL-proximal for logistic loss."""

    def __init__(self, width: int):
        self.z, self.n = np.zeros(width), np.zeros(width)

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        gradient = (_logistic(w @ values) - label) * values
        n = self.n[at]
        grown = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(grown) - np.sqrt(n)) / ALPHA * w
        self.n[at] = grown


def _logistic(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def train(batches: Iterator[pa.RecordBatch], bits: int = BITS, epochs: int = EPOCHS, most: int = MOST_TRAINING) -> np.ndarray:
    """Weights from batches of (order, label, data). Of more than ``most`` rows (repeated ids) those first in order stay,
    however they arrive."""
    held: list[tuple] = []  # a heap, the last in order on top
    for batch in batches:
        for order, label, data in zip(*(c.to_pylist() for c in batch.columns)):
            if len(held) < most:
                heapq.heappush(held, (-order, label, data))
            elif held and -order > held[0][0]:
                heapq.heapreplace(held, (-order, label, data))
    rows = [(-order, label, *(a.astype(t) for a, t in zip(features(data, bits), (np.int32, np.float32)))) for order, label, data in sorted(held, reverse=True)]
    del held
    model = Ftrl((1 << bits) + 1)
    order = np.random.RandomState(0)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            _, label, at, values = rows[k]
            model.learn(at, values, label)
    return model.weights(slice(None)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *,
        bits: int = BITS, most: int = MOST_TRAINING) -> np.ndarray:
    """Weights learned from labels outside the held-out fold."""
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, FOLDS) != HELD_OUT))
    kind = "long" if docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long") else "string"
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col).cast(kind)), F.lit(SAMPLE_GRID))
    share = min(1.0, 0.98 * most / max(1, usable.count()))
    # At most about MOST_TRAINING ids and labels: a proven bound for the broadcast.
    sample = (
        usable.filter(place < int(share * SAMPLE_GRID) if share < 1 else F.lit(True))
        .groupBy(F.col(id_col).cast(kind).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    )
    rows = docs.select(F.col(id_col).cast(kind).alias("_id"), as_text(text_col).alias("_data")).join(F.broadcast(sample), "_id")
    rows = rows.select(F.xxhash64("_id", "_data").alias("order"), "_label", "_data")

    def one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([train(batches, bits, most=most).tobytes()], pa.binary())], names=["weights"])

    found = rows.repartition(1).mapInArrow(one_task, "weights binary").collect()
    return np.frombuffer(found[0][0], np.float32) if found else np.zeros((1 << bits) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", *, bits: int = BITS) -> DataFrame:
    """(id, score) of each row."""
    model = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for i, data in enumerate(batch.column(1)):
                at, values = features(data.as_buffer().to_pybytes(), bits)
                scores[i] = _logistic(float(w[at] @ values))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=[id_col, "score"])

    return docs.select(F.col(f"`{id_col}`"), as_text(text_col).alias("_data")).mapInArrow(run, f"`{id_col}` {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of each row."""
    shared_dir(docs.sparkSession)
    scored = score(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select(id_col, (fold(id_col, FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, weights: np.ndarray, text_col: str = "text", threshold: float = 0.5, *, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, with their columns."""
    model = docs.sparkSession.sparkContext.broadcast(weights)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            keep = []
            for text in batch.column(place):
                at, values = features((text.as_py() or "").encode(), bits)
                keep.append(_logistic(float(w[at] @ values)) >= threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
