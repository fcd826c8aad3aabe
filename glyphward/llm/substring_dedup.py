"""Substring dedup: words inside a window of 35 words that is found anywhere else are removed.

Prefilter: a count-min sketch of ``ROWS`` rows over all windows. A window's cells are two hashes of its anchor, the
smallest-hashed 12-word run inside it; equal windows have equal anchors at equal offsets, and an anchor is counted
once for each place it is at, so no count is less than that of any window that falls into the cell, and the least of
a window's counts is an over-estimate: none is lost. A row has as many cells as the corpus has bytes (the next power
of two), some sixty for each anchor. Tasks build sketches of their documents sparsely, as (cell, count), and sketches
merge by adding, so no task ever holds one whole. Cells counted once are sent back to their one document.

Second pass: windows whose cells were all counted twice or more are grouped exactly, by a cryptographic digest (128 bits
of BLAKE2b) of their words. A group of one is a false alarm of the prefilter, and its only member is where its minimum
says; so what is sent back is the singles, without a join, and a window that is in a third of all documents is combined
in each task before it moves. Equal texts take part once, weighted by their number.

Texts move once (to meet their singles), and those with a repeated cell a second time. Each step is written before
the next.

Edge cases: a null text has no words; texts of fewer than 35 words lose nothing; a window may repeat within its own
document, overlapping itself too; windows are judged on the input; repeated rows are documents each, so their
windows repeat; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import WordHashes, leftmost_minimum, mixed, windows
from .shared import drop_written, keyed, shared_dir, written

WINDOW = 35
ANCHOR = 12
#: Rows of the count-min sketch.
ROWS = 2


def width_of(docs: DataFrame, text_col: str) -> int:
    """log2 of the cells of a row: one for each byte of text at least."""
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")).cast("long"))).first()[0] or 0
    return min(60, max(10, int(total).bit_length()))


def anchors(hashes: np.ndarray, window: int, anchor: int, cell_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window the place of its anchor; and for each place its cell in each row, numbered through all rows."""
    runs = windows(hashes, anchor)
    cells = [(mixed(runs + np.uint64(row)) >> np.uint64(64 - cell_bits)) * np.uint64(ROWS) + np.uint64(row) for row in range(ROWS)]
    return leftmost_minimum(runs, window - anchor + 1), np.stack(cells).astype(np.int64)


def _sketch(window: int, anchor: int, cell_bits: int):
    """(r, data) to the sparse sketch (cell, n, r)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            cells, counts, owners, held = [], [], [], 0
            for r, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                split = data.as_buffer().to_pybytes().split()
                if len(split) >= window:
                    place, cell = anchors(words.of(split), window, anchor, cell_bits)
                    found, n = np.unique(cell[:, np.unique(place)], return_counts=True)
                    cells.append(found)
                    counts.append(n)
                    owners.append(np.full(len(found), r))
                    held += len(found)
                if held > 1 << 18:
                    yield _batch(("cell", cells), ("n", counts), ("r", owners))
                    cells, counts, owners, held = [], [], [], 0
            if held:
                yield _batch(("cell", cells), ("n", counts), ("r", owners))

    return run


def _batch(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for _, c in columns], names=[n for n, _ in columns])


def _suspects(window: int, anchor: int, cell_bits: int):
    """(data, d1, d2, copies, singles) to documents with a window whose least count is two or more: a bit for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            keep, bits = [], []
            for i, (data, singles) in enumerate(zip(batch.column(0), batch.column(4))):
                split = data.as_buffer().to_pybytes().split()
                if len(split) < window:
                    continue
                place, cell = anchors(words.of(split), window, anchor, cell_bits)
                once = np.asarray(singles.values) if singles.is_valid else np.empty(0, np.int64)
                suspect = ~np.isin(cell, once).any(axis=0)[place]
                if suspect.any():
                    keep.append(i)
                    bits.append(np.packbits(suspect).tobytes())
            if keep:
                kept = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*kept.columns[:4], pa.array(bits, pa.binary())], names=["data", "d1", "d2", "copies", "bits"])

    return run


def _starts(bits: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))


def _exact(window: int):
    """(mid, data, copies, bits) to (w1, w2, n, mid, at): the suspected windows, each document's equal ones added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [[] for _ in range(5)], 0
            for mid, data, copies, bits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                split = data.as_buffer().to_pybytes().split()
                at = _starts(bits)
                text = b" ".join(split)
                ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1)
                first, last = np.concatenate([[0], ends])[at].tolist(), (ends[at + window - 1] - 1).tolist()
                digests = b"".join([blake2b(text[a:b], digest_size=16).digest() for a, b in zip(first, last)])
                w = np.frombuffer(digests, np.int64).reshape(-1, 2)
                for column, value in zip(out, (w[:, 0], w[:, 1], np.full(len(at), copies), np.full(len(at), mid), at)):
                    column.append(value)
                held += len(at)
                if held > 1 << 18:
                    yield _batch(*zip(("w1", "w2", "n", "mid", "at"), out))
                    out, held = [[] for _ in range(5)], 0
            if held:
                yield _batch(*zip(("w1", "w2", "n", "mid", "at"), out))

    return run


def _kept(window: int):
    """(data, d1, d2, bits, singles) to (d1, d2, n_removed, kept_sha256) of texts that lose words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, removed, digests = [], [], []
            for i, (data, bits, singles) in enumerate(zip(batch.column(0), batch.column(3).to_pylist(), batch.column(4))):
                split = data.as_buffer().to_pybytes().split()
                at = _starts(bits)
                if singles.is_valid:
                    at = np.setdiff1d(at, np.asarray(singles.values), assume_unique=True)
                if not len(at):
                    continue
                edge = np.zeros(len(split) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                covered = np.cumsum(edge[:-1]) > 0
                rows.append(i)
                removed.append(int(covered.sum()))
                digests.append(hashlib.sha256(b" ".join(split[k] for k in np.flatnonzero(~covered).tolist())).hexdigest())
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [kept.column(1), kept.column(2), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=["d1", "d2", "n_removed", "sha"])

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, d1, d2, data) to (id, d1, d2, n_words, whole): what a text that loses nothing has."""
    for batch in batches:
        split = [data.as_buffer().to_pybytes().split() for data in batch.column(3)]
        digests = [hashlib.sha256(b" ".join(s)).hexdigest() for s in split]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(s) for s in split], pa.int64()), pa.array(digests)], names=["id", "d1", "d2", "n_words", "whole"])


def _affected(docs: DataFrame, id_col: str, text_col: str, window: int, anchor: int, cell_bits: int) -> DataFrame:
    """(d1, d2, n_removed, sha) of the texts that lose words."""
    rows = keyed(docs, id_col, text_col)
    sketch = rows.select("r", "data").mapInArrow(_sketch(window, anchor, cell_bits), "cell bigint, n bigint, r bigint")
    once = sketch.groupBy("cell").agg(F.sum("n").alias("n"), F.min("r").alias("r")).filter("n = 1")
    singles = written(once.groupBy("r").agg(F.collect_list("cell").alias("singles")), "cells")  # a document's own cells
    one_of = rows.groupBy("d1", "d2").agg(F.min("r").alias("r"), F.count(F.lit(1)).alias("copies"))
    asked = one_of.join(singles, "r", "left").withColumnsRenamed({"d1": "e1", "d2": "e2", "r": "e"})  # small; texts move once
    texts = rows.select("r", "d1", "d2", "data").join(asked, (F.col("r") == F.col("e")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")))
    suspects = texts.select("data", "d1", "d2", "copies", "singles").mapInArrow(
        _suspects(window, anchor, cell_bits), "data binary, d1 bigint, d2 bigint, copies bigint, bits binary")
    suspects = written(suspects.withColumn("mid", F.monotonically_increasing_id()), "suspects")
    drop_written(singles)
    exact = suspects.select("mid", "data", "copies", "bits").mapInArrow(_exact(window), "w1 bigint, w2 bigint, n bigint, mid bigint, at bigint")
    alone = exact.groupBy("w1", "w2").agg(F.sum("n").alias("n"), F.min("mid").alias("mid"), F.min("at").alias("at")).filter("n = 1")
    alone = written(alone.groupBy("mid").agg(F.collect_list("at").alias("singles")), "windows")  # a document's own windows
    judged = suspects.join(alone, "mid", "left").select("data", "d1", "d2", "bits", "singles")
    removed = written(judged.mapInArrow(_kept(window), "d1 bigint, d2 bigint, n_removed bigint, sha string").dropDuplicates(["d1", "d2"]), "removed")
    drop_written(suspects, alone)
    return removed


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, anchor: int = ANCHOR,
                    cell_bits: int | None = None) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of each row. ``docs`` is read a few times and has to give the same rows."""
    shared_dir(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    lost = _affected(docs, id_col, text_col, window, min(anchor, window), cell_bits or width_of(docs, text_col))
    whole = keyed(docs, id_col, text_col).select("id", "d1", "d2", "data").mapInArrow(_whole, f"id {kind}, d1 bigint, d2 bigint, n_words bigint, whole string")
    joined = whole.join(lost, ["d1", "d2"], "left")
    return joined.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("sha", "whole").alias("kept_sha256"))
