"""Dealing out rows to tasks for work that is heavy on each row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a task, about.
TASK = 8 << 20
#: Bytes of text that a task works on at a time.
PIECE = 1 << 20


def tasks(df: DataFrame) -> int:
    """As many as there are cores at least, each with some ``TASK`` bytes of text."""
    sizes = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)).cast("long") for f in df.schema.fields if f.dataType.typeName() == "string"]
    found = df.agg(F.sum(sum(sizes, F.lit(0)))).first()[0] or 0
    cores = df.sparkSession.sparkContext.defaultParallelism
    return cores * max(1, -(-found // (TASK * cores)))  # whole rounds: a last one of few tasks takes as long as any


def spread(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``df`` dealt out to ``tasks``, however the table lies in its files. ``of``: the table whose text is looked at, where
    ``df`` is made from it."""
    return df.repartition(tasks(df if of is None else of))


def pieces(batch: pa.RecordBatch, text: str, times: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, some ``PIECE`` bytes (or ``times`` as many) of the column ``text`` at a time; a longer text is
    alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends, first = np.cumsum(sizes, dtype=np.int64), 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + PIECE * times, "right")))
        yield batch.slice(first, last - first)
        first = last
