"""Hard-negative mining with a vector-approximation file.

Each component of a vector becomes a whole number and then the number of its cell, one byte, of up to 256 cells for each
dimension. Cells follow all rows: equal steps over four standard deviations on either side of the mean, and two cells out
to the least and greatest value. The approximations are written in blocks of rows, ordered by label within a block, with
the vectors beside them.

For an anchor, a table for each dimension holds the least and the greatest product of its component with any value of a
cell; looked up and summed over dimensions they are a lower and an upper bound of a row's score. Round one looks for
positives: of a block, a row is scored exactly only if its upper bound reaches the fifth-greatest lower bound of its
label. Round two looks for negatives: a row is scored only if its bounds can meet some window of the anchor and its upper
bound reaches the tenth-greatest lower bound of rows that are surely in that window. A block returns its first five, or
its first ten for each window, which always hold the whole answer's; the best over all blocks follow by rank, which Spark
limits before it shuffles.

How it scales: anchors are a stated query set (rows whose id is divisible by ``every``) and meet all rows in blocks:
anchors are written in groups of ``GROUP_BYTES`` at most; one group at a time is sent to all tasks, each of which passes
its blocks of the file. Nothing of the rows moves, and what a task holds is one block and one group, whatever the table's
size and however many copies a vector has. The work is that of each anchor with each row's bytes, as the contract asks.

Edge cases: rows with a null label or vector, or a null or non-finite component, take no part; vectors shorter than the
longest go on with zeros, which add nothing to a score; a row with an anchor's id is neither its positive nor its
negative; repeated rows are rows of their own, but equal anchors are one; rows with a null id come after
any other at the same score and are never anchors; an anchor without other rows of its label has no positives; scores that could
pass 2 ** 62 are an error; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_written, shared_dir, written

POSITIVES, NEGATIVES = 5, 10
#: Anchors are the rows with these ids; labels of rows with those ids are moved on.
ANCHORS_EVERY, MOVED_EVERY, LABELS = 100, 7, 10
#: The window of a negative's score, in hundredths of the positive's.
LOW, HIGH = 30, 90
#: Rows of a block, cells of a dimension, standard deviations that equal cells span, bytes of a group of anchors.
BLOCK_ROWS, CELLS, SPAN, GROUP_BYTES = 4096, 256, 4.0, 16 << 20
NO_ID = np.iinfo(np.int64).max
SCALE = 256


def prepared(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, v): the rows that take part, components as whole numbers, labels moved on where the id says so."""
    label, vec_id = F.col(f"`{label_col}`").cast("long"), F.col(f"`{id_col}`").cast("long")
    moved = F.when(vec_id % MOVED_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    doubles = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(label.isNotNull() & doubles.isNotNull() & fine).select(vec_id.alias("id"), moved.alias("label"), F.transform(doubles, lambda x: F.floor(x * SCALE)).alias("v"))


def edges_of(rows: DataFrame) -> list[np.ndarray]:
    """For each dimension the least values of its cells, and one more than its greatest value: numbers of all rows."""
    values = rows.select(F.posexplode("v").alias("j", "x"))
    facts = values.groupBy("j").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"), F.coalesce(F.stddev("x"), F.lit(0.0)).alias("sd")).orderBy("j").collect()
    if sum(max(abs(f["low"]), abs(f["high"])) ** 2 for f in facts) >= 2**62:
        raise ValueError("components are too large for scores in 64 bits")
    out = []
    for f in facts:
        low, high = min(f["low"], 0), max(f["high"], 0)  # short vectors go on with zeros
        inner = np.floor(np.linspace(f["mean"] - SPAN * f["sd"], f["mean"] + SPAN * f["sd"], CELLS - 1)).astype(np.int64)
        out.append(np.unique(np.concatenate([[low], inner[(inner > low) & (inner <= high)], [high + 1]])))
    return out


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    offsets, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), dims), np.int64)
    at = np.repeat(np.arange(len(sizes)), sizes), np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)
    out[at] = flat[offsets[0]:offsets[-1]]
    return out


def approximated(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """The file, written: (ids, labels, cells, vectors) of a block of rows each, ordered by label. Cells are stored
    dimension by dimension, one byte each."""
    dims = len(edges)

    def block(ids, labels, vectors) -> pa.RecordBatch:
        order = np.argsort(labels, kind="stable")
        ids, labels, vectors = ids[order], labels[order], vectors[order]
        cells = np.stack([np.searchsorted(e, vectors[:, j], "right") - 1 for j, e in enumerate(edges)]).astype(np.uint8) if dims else np.zeros((0, len(ids)), np.uint8)
        arrays = [pa.array([len(ids)], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in (ids, labels, cells, vectors.astype(_kind(edges))))]
        return pa.RecordBatch.from_arrays(arrays, names=["n", "ids", "labels", "cells", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            part = ids, batch.column(1).to_numpy(zero_copy_only=False), _matrix(batch.column(2), dims)
            for a in range(0, len(ids), BLOCK_ROWS):
                held.append([x[a:a + BLOCK_ROWS] for x in part])
                n += len(held[-1][0])
                while n >= BLOCK_ROWS:
                    whole = [np.concatenate(x) for x in zip(*held)]
                    yield block(*(x[:BLOCK_ROWS] for x in whole))
                    held, n = [[x[BLOCK_ROWS:] for x in whole]], n - BLOCK_ROWS
        if n:
            yield block(*(np.concatenate(x) for x in zip(*held)))

    return written(rows.mapInArrow(run, "n int, ids binary, labels binary, cells binary, vectors binary"), "approximations")


def _kind(edges: list[np.ndarray]) -> type:
    """The narrowest kind of number that holds all components."""
    most = max((max(-int(e[0]), int(e[-1]) - 1) for e in edges), default=0)
    return np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64


class Block:
    """A block of the file in a task."""

    def __init__(self, n: int, ids: bytes, labels: bytes, cells: bytes, vectors: bytes, edges: list[np.ndarray]):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.cells, self.vectors = np.frombuffer(cells, np.uint8).reshape(len(edges), n), np.frombuffer(vectors, _kind(edges)).reshape(n, len(edges))
        self.edges = edges

    def same(self, label: int) -> slice:
        return slice(*(int(np.searchsorted(self.labels, label, side)) for side in ("left", "right")))

    def tables(self, anchor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each dimension, the least and greatest product of the anchor's component with a cell's values."""
        ends = [(a * e[:-1], a * (e[1:] - 1)) for a, e in zip(anchor, self.edges)]
        return [(np.minimum(x, y), np.maximum(x, y)) for x, y in ends]

    def bounds(self, anchor: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        low, high = (np.zeros(rows.stop - rows.start, np.int64) for _ in range(2))
        for (least, most), cells in zip(self.tables(anchor), self.cells):
            low += least.take(cells[rows])
            high += most.take(cells[rows])
        return low, high

    def scores(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.vectors[rows].astype(np.int64) @ anchor

    def first(self, scores: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
        """Places of the first rows, by score and id."""
        return np.lexsort((self.ids[rows], -scores))[:most]


def _reach(low: np.ndarray, most: int) -> int | None:
    """The ``most``-th greatest of the lower bounds: rows whose upper bound is less are not among the first."""
    return int(np.partition(low, len(low) - most)[len(low) - most]) if len(low) >= most else None


def positives_in(block: Block, anchor_id: int, label: int, anchor: np.ndarray, most: int = POSITIVES) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the block's first rows with the anchor's label."""
    rows = block.same(label)
    at = np.arange(rows.start, rows.stop)
    other = block.ids[rows] != anchor_id
    low, high = block.bounds(anchor, rows)
    reach = _reach(low[other], most)
    at = at[other & (high >= reach)] if reach is not None else at[other]
    scores = block.scores(anchor, at)
    best = block.first(scores, at, most)
    return block.ids[at[best]], scores[best]


def negatives_in(block: Block, anchor_id: int, label: int, anchor: np.ndarray, positives: list[int], most: int = NEGATIVES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each positive's score: (its place, ids, scores) of the block's first rows in its window. Rows are scored once
    for all windows that they may enter."""
    same = block.same(label)
    low, high = block.bounds(anchor, slice(0, len(block.ids)))
    able = block.ids != anchor_id
    able[same] = False
    wanted, windows = np.zeros(len(able), bool), []
    for score in positives:
        # Whole numbers: LOW * score <= 100 * s <= HIGH * score.
        least, greatest = -(-LOW * score // 100), HIGH * score // 100
        may = able & (high >= least) & (low <= greatest)
        sure = may & (low >= least) & (high <= greatest)
        reach = _reach(low[sure], most)
        if reach is not None:
            may &= high >= reach
        windows.append((least, greatest, may))
        wanted |= may
    at = np.flatnonzero(wanted)
    if not len(at):
        return
    scores = np.zeros(len(able), np.int64)
    scores[at] = block.scores(anchor, at)
    for place, (least, greatest, may) in enumerate(windows):
        rows = np.flatnonzero(may & (scores >= least) & (scores <= greatest))
        best = block.first(scores[rows], rows, most)
        if len(best):
            yield place, block.ids[rows[best]], scores[rows[best]]


def _searched(file: DataFrame, edges: list[np.ndarray], work, columns: str) -> DataFrame:
    """``work(block)`` gives rows of numbers for each block of the file."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, *parts in zip(*(c.to_pylist() for c in batch.columns)):
                found = [np.concatenate(x) for x in zip(*work(Block(n, *parts, edges)))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=names)

    return file.mapInArrow(run, columns)


def _each(n: int, value) -> np.ndarray:
    return np.full(n, value, np.int64)


def mine(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, every: int = ANCHORS_EVERY, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    spark = rows.sparkSession
    shared_dir(spark)
    took_part = written(prepared(rows, id_col, vector_col, label_col), "vectors")
    edges = edges_of(took_part)
    dims, context = len(edges), spark.sparkContext
    file = approximated(took_part, edges)
    anchors = took_part.filter(F.col("id") % every == 0).distinct()
    groups = max(1, -(-anchors.count() * (dims + 2) * 8 // group_bytes))
    dealt = written(anchors.withColumn("group", F.pmod(F.xxhash64("id", "label", "v"), F.lit(groups)).cast("int")).repartitionByRange(groups, "group").sortWithinPartitions("group"), "anchors")
    drop_written(took_part)
    parts = []
    for group in range(groups):
        found = dealt.filter(F.col("group") == group).select("id", "label", "v").orderBy("id", "label", "v").collect()  # at most about group_bytes
        if found:
            parts.append(_group(context, file, edges, [(r[0], r[1], np.array([*r[2], *[0] * (dims - len(r[2]))], np.int64)) for r in found]))
    drop_written(file, dealt)
    if not parts:
        return spark.createDataFrame([], RESULT)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _group(context, file: DataFrame, edges: list[np.ndarray], anchors: list[tuple]) -> DataFrame:
    """The rows of one group of anchors, written."""
    sent = context.broadcast(anchors)

    def look_for_positives(block: Block):
        for k, (anchor_id, label, anchor) in enumerate(sent.value):
            ids, scores = positives_in(block, anchor_id, label, anchor)
            if len(ids):
                yield _each(len(ids), k), ids, scores

    order = Window.partitionBy("k").orderBy(F.desc("score"), "id")
    near = _searched(file, edges, look_for_positives, "k bigint, id bigint, score bigint").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= POSITIVES)
    positives: list[list[tuple[int, int]]] = [[] for _ in anchors]
    for r in near.orderBy("k", "place").collect():  # five numbers an anchor of the group
        positives[r["k"]].append((r["id"], r["score"]))
    known = context.broadcast(positives)

    def look_for_negatives(block: Block):
        for k, (anchor_id, label, anchor) in enumerate(sent.value):
            if known.value[k]:
                for place, ids, scores in negatives_in(block, anchor_id, label, anchor, [s for _, s in known.value[k]]):
                    positive_id, positive_score = known.value[k][place]
                    yield tuple(_each(len(ids), x) for x in (k, place, anchor_id, positive_id, positive_score)) + (ids, scores)

    columns = "k bigint, place bigint, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    order = Window.partitionBy("k", "place").orderBy(F.desc("negative_score"), "negative_id")
    hard = _searched(file, edges, look_for_negatives, columns).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEGATIVES)
    known_id = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    hard = written(hard.select("anchor_id", known_id("positive_id"), "rank", known_id("negative_id"), "positive_score", "negative_score"), "negatives")
    sent.unpersist()
    known.unpersist()
    return hard
