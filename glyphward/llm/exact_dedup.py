"""Exact dedup by a log-structured merge index.

Each task is a memtable: a dictionary from digest to (bytes, kept id, copies). A second row with the same digest
is a hit and its bytes are compared at once. When the bytes held pass a bound, the memtable is flushed as a run
sorted by digest, without the bytes, with its fences (first and last digest) and a Bloom filter of its digests.
Compaction merges the runs by digest range: each range is sorted, equal digests become one entry with the best of the
runs' kept ids, and copies add up. :func:`lookup` asks an index for new texts: a run is read only for digests that are
between its fences and pass its filter.

A digest that is in more than one run is a hit between runs, whose bytes are verified in a second scan. A Bloom filter
of these hits (sixteen bits for each) tells the scan which rows it may concern; it is broadcast up to ``FILTER_BYTES``,
beyond which it is left out and the join that decides sees all rows. Each task ships one row for each such text. Texts
that are no hit never leave their task, and a hot text costs a row a run, not a row a copy.

Edge cases: a null text is the empty string; a null id loses to any other id and is kept only where all ids of
the group are null; repeated rows are copies, each has its output row, and ``kept`` is true for each of several
rows that share the kept id; ids are whole numbers or, in any other type, compared as strings; an empty table gives
an empty result; further columns of the input are ignored. Digests that collide (only with a shortened digest, as in
tests) are told apart by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_text, drop_written, shared_dir, written

#: A memtable is flushed when it holds so many bytes of text.
MEMTABLE_BYTES = 32 << 20
#: A filter of hits is broadcast up to this size (33 million hits).
FILTER_BYTES = 64 << 20
FILTER_BITS = 16
RUN_FILTER_BITS = 10
FILTER_HASHES = 3


def _digest(data: bytes, digest_bytes: int) -> bytes:
    return hashlib.sha256(data).digest()[:digest_bytes]


def places(digests: list[bytes], bits: int) -> np.ndarray:
    """The bits of each digest in a filter: parts of the digest are its hashes."""
    padded = np.frombuffer(b"".join(d.ljust(8 * FILTER_HASHES, b"\0")[:8 * FILTER_HASHES] for d in digests), np.uint64).reshape(-1, FILTER_HASHES)
    with np.errstate(over="ignore"):
        mixed = (padded ^ (padded[:, :1] << np.uint64(7)) ^ np.arange(FILTER_HASHES, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(20)) % np.uint64(bits)).astype(np.int64)


def bloom(digests: list[bytes], bits_each: int) -> np.ndarray:
    """A filter of whole 64-bit words as bytes."""
    held = np.zeros(64 * max(1, -(-bits_each * len(digests) // 64)), bool)
    if digests:
        held[places(digests, len(held)).ravel()] = True
    return np.packbits(held)


def maybe(filter_bytes: np.ndarray, digests: list[bytes]) -> np.ndarray:
    """Which digests pass a filter."""
    if not digests:
        return np.empty(0, bool)
    at = places(digests, 8 * len(filter_bytes))
    return (filter_bytes[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=1)


RUNS = "digest binary, keep_id {}, copies bigint, run bigint, last binary, filter binary"


def _flush(table: dict, run: int, kind: pa.DataType) -> pa.RecordBatch:
    """A run: its entries in order; the first carries the last digest and the filter."""
    rows = sorted(((d, t[1], t[2]) for d, held in table.items() for t in held), key=lambda r: r[0])
    head = [None] * (len(rows) - 1)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64()), pa.array([run] * len(rows), pa.int64()),
            pa.array([rows[-1][0], *head], pa.binary()), pa.array([bloom([r[0] for r in rows], RUN_FILTER_BITS).tobytes(), *head], pa.binary()),
        ],
        names=["digest", "keep_id", "copies", "run", "last", "filter"],
    )


def memtable_runs(digest_bytes: int, memtable_bytes: int, largest: bool):
    """Arrow batches of (id, data) to sorted runs."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table: dict[bytes, list[list]] = {}
        held, run, kind = 0, TaskContext.get().partitionId() << 24, pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_buffer().to_pybytes() if data.is_valid else b""
                d = _digest(data, digest_bytes)
                for entry in table.setdefault(d, []):
                    if entry[0] == data:  # the hit's bytes
                        if key is not None and (entry[1] is None or (key > entry[1]) == largest):
                            entry[1] = key
                        entry[2] += 1
                        break
                else:
                    table[d].append([data, key, 1])
                    held += len(data) + 200
                if held > memtable_bytes:
                    yield _flush(table, run, kind)
                    table, held, run = {}, 0, run + 1
        if table:
            yield _flush(table, run, kind)

    return build


def id_kind(docs: DataFrame, id_col: str) -> str:
    """bigint for whole numbers, else string."""
    return "bigint" if docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long") else "string"


def flushed(docs: DataFrame, id_col: str, text_col: str, largest: bool, digest_bytes: int, memtable_bytes: int) -> DataFrame:
    """Level 0, written: the runs of all memtables."""
    kind = id_kind(docs, id_col)
    rows = docs.select(F.col(f"`{id_col}`").cast(kind).alias("id"), as_text(text_col).alias("data"))
    return written(rows.mapInArrow(memtable_runs(digest_bytes, memtable_bytes, largest), RUNS.format(kind)), "runs")


def compacted(level0: DataFrame, largest: bool) -> DataFrame:
    """Level 1, written: (digest, keep_id, group_size, runs), merged and sorted by digest range."""
    best = F.max if largest else F.min
    by_range = level0.select("digest", "keep_id", "copies").repartitionByRange("digest").sortWithinPartitions("digest")
    return written(by_range.groupBy("digest").agg(best("keep_id").alias("keep_id"), F.sum("copies").alias("group_size"), F.count(F.lit(1)).alias("runs")), "level")


def lookup(docs: DataFrame, level0: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, keep_id, copies, run) of the entries of an index's runs that have the digest of a row of ``docs``. Only
    (row, run) pairs that a run's fences and filter let through meet the run's entries."""
    runs = level0.filter("filter IS NOT NULL").select("run", "digest", "last", "filter").toArrow()  # ten bits an entry
    table = list(zip(*(runs.column(c).to_pylist() for c in ("run", "digest", "last", "filter"))))
    if sum(len(t[3]) for t in table) > FILTER_BYTES:
        return level0.select("digest", "keep_id", "copies", "run").join(docs.select(F.unhex(F.sha2(as_text(text_col), 256)).alias("digest")).distinct(), "digest", "left_semi")
    seen = docs.sparkSession.sparkContext.broadcast([(run, first, last, np.frombuffer(bits, np.uint8)) for run, first, last, bits in table])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = sorted({_digest(d, 32) for d in batch.column(0).to_pylist()})
            found, where = [], []
            for run, first, last, bits in seen.value:
                between = [d for d in digests if first <= d <= last]
                passed = [d for d, yes in zip(between, maybe(bits, between)) if yes]
                found += passed
                where += [run] * len(passed)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(where, pa.int64())], names=["digest", "run"])

    asked = docs.select(as_text(text_col).alias("data")).mapInArrow(ask, "digest binary, run bigint").distinct()
    return level0.select("digest", "keep_id", "copies", "run").join(asked, ["digest", "run"], "left_semi")


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, largest: bool = True,
          digest_bytes: int = 32, memtable_bytes: int = MEMTABLE_BYTES, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """The compacted index: (digest, data, keep_id, group_size). ``data`` is null but for digests with several
    texts, which it tells apart."""
    level0 = flushed(docs, id_col, text_col, largest, digest_bytes, memtable_bytes)
    level1 = compacted(level0, largest)
    drop_written(level0)
    hits = level1.filter("runs > 1").select("digest")
    whole = level1.select("digest", F.lit(None).cast("binary").alias("data"), "keep_id", "group_size")
    if hits.isEmpty():
        return whole
    rows = docs.select(F.col(f"`{id_col}`").cast(id_kind(docs, id_col)).alias("id"), as_text(text_col).alias("data"))
    collided = written(_verify(rows, hits, digest_bytes, filter_bytes), "collided")
    if collided.isEmpty():
        return whole
    # Not with whole SHA-256 digests: rows under a digest with several texts are grouped by those texts.
    best = F.max if largest else F.min
    keyed = rows.select("id", "data", _native_digest(digest_bytes).alias("digest")).join(collided, "digest", "left_semi")
    apart = keyed.groupBy("digest", "data").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return whole.join(collided, "digest", "left_anti").unionByName(apart)


def _native_digest(digest_bytes: int):
    return F.substring(F.unhex(F.sha2("data", 256)), 1, digest_bytes)


def hits_filter(hits: DataFrame, most_bytes: int) -> np.ndarray | None:
    """A filter sized by the hits: tasks send the bytes of theirs that have a bit, and the driver adds them up. None:
    it would pass ``most_bytes``."""
    count = hits.count()
    if FILTER_BITS * count > 8 * most_bytes:
        return None
    size = 64 * max(1, -(-FILTER_BITS * count // 64))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = places(batch.column(0).to_pylist(), size).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(at >> 3), pa.array(128 >> (at & 7))], names=["at", "bits"])

    found = hits.mapInArrow(bits, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # size / 8 rows at most
    out = np.zeros(size // 8, np.uint8)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out


def _verify(rows: DataFrame, hits: DataFrame, digest_bytes: int, filter_bytes: int) -> DataFrame:
    """Digests under which more than one text was found."""
    bits = hits_filter(hits, filter_bytes)
    seen = rows.sparkSession.sparkContext.broadcast(bits)

    def once_a_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shipped: dict[bytes, bytes] = {}
        for batch in batches:
            digests, take = batch.column(0).to_pylist(), []
            for i in range(len(digests)) if seen.value is None else np.flatnonzero(maybe(seen.value, digests)).tolist():
                check = hashlib.blake2b(batch.column(1)[i].as_buffer(), digest_size=16).digest()
                if shipped.get(digests[i]) != check:
                    if len(shipped) > 200_000:
                        shipped.clear()
                    shipped[digests[i]] = check
                    take.append(i)
            if take:
                yield batch.take(pa.array(take))

    return (
        rows.select(_native_digest(digest_bytes).alias("digest"), "data")
        .mapInArrow(once_a_task, "digest binary, data binary")
        .join(hits, "digest", "left_semi")
        .groupBy("digest", "data").agg(F.lit(1).alias("one"))
        .groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
        .filter("texts > 1")
        .select("digest")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, largest: bool = True,
                digest_bytes: int = 32, **index_options) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256; columns of ``docs`` with these names are replaced.
    ``docs`` is read again for each step, so it has to give the same rows each time."""
    shared_dir(docs.sparkSession)
    groups = index(docs, id_col, text_col, largest=largest, digest_bytes=digest_bytes, **index_options)
    made = {"keep_id", "group_size", "kept", "text_sha256"}
    sha = F.sha2(as_text(text_col), 256)
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made], sha.alias("text_sha256"))
    rows = rows.withColumn("_digest", F.substring(F.unhex("text_sha256"), 1, digest_bytes))
    groups = groups.withColumnsRenamed({"digest": "_digest", "data": "_data"})
    on = rows["_digest"] == groups["_digest"]
    if digest_bytes < 32:
        on = on & (groups["_data"].isNull() | (groups["_data"] == as_text(text_col)))
    joined = rows.join(groups, on).drop(groups["_digest"])
    # A group whose ids are all null keeps its rows: there is no id to tell them apart.
    return joined.withColumn("kept", F.col(f"`{id_col}`").cast(id_kind(docs, id_col)).eqNullSafe(F.col("keep_id"))).drop("_digest", "_data")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, largest: bool = True) -> DataFrame:
    """The rows of ``docs`` that stay, with all its columns as they are; of rows with the same text and id one stays.
    Rows meet the index by id and digest together, so the copies of a hot text are dealt out by their ids."""
    shared_dir(docs.sparkSession)
    kept = index(docs, id_col, text_col, largest=largest).select(F.col("digest").alias("_kept_digest"), F.col("keep_id").alias("_kept_id"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row = F.struct(*columns).alias("_row")
    rows = docs.select(row, F.unhex(F.sha2(as_text(text_col), 256)).alias("_digest"), F.col(f"`{id_col}`").cast(id_kind(docs, id_col)).alias("_id"))
    stay = rows.join(kept, (F.col("_digest") == F.col("_kept_digest")) & F.col("_id").eqNullSafe(F.col("_kept_id")), "left_semi")
    twins = rows.groupBy("_digest", "_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not twins.isEmpty():  # digests and ids only; as a rule ids are unique, and texts move once
        stay = stay.dropDuplicates(["_digest", "_id"])
    return stay.select("_row.*")
