"""The layered classifier on TF-IDF: truncated SVD, scaling, one hidden layer, all fitted over partitions.

The SVD is a randomized one of the rows as they are, sparse and not centred. A Gaussian matrix of features x width is
made orthonormal and multiplied by rows' transpose times rows, a few times over; each time a task adds up its rows'
share, cut into blocks of features, and blocks of the same features are added up where they meet. What the rows make of
the last matrix is reduced to a triangle by a QR in each task and merges of triangles in a tree; the triangle's SVD
gives singular values and components. The driver holds matrices of features x width and width x width: both are
parameters. Rows never leave their tasks.

The layer is trained by Adam on mini-batches. Rows are dealt into batches and a held-out tenth by hashes of their key,
with seeds of their own, and written by batch. A step needs the one before it, so batches of few rows are taken one after
the other by a task, up to ``CHAIN`` rows in a job; a batch of more rows is a job, in which each task adds up its rows'
gradients. Training ends when the accuracy on the held-out rows has not grown for ``patience`` epochs, and keeps the
weights of the best one. Nothing bounds the number of rows; a task sees no more than ``CHAIN`` of them.
"""

from __future__ import annotations

import copy
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.remote import file_system
from ..sources.scratch import scratch, written

#: Features of a block of a sum; triangles merged at a time.
BLOCK, FAN = 1024, 32
#: Rows and entries that are multiplied at a time; a longer row is alone.
ROWS, ENTRIES = 1024, 1 << 21
#: Features of a tile, and the share of its cells from which on it is made dense.
TILE, DENSE = 1024, 1 / 32


# Sparse rows in a task ------------------------------------------------------------------------------------------------


@dataclass
class Sparse:
    """Some sparse rows: the entries of row i are at ``starts[i]`` to ``starts[i + 1]``."""

    starts: np.ndarray
    places: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, vectors: pa.StructArray) -> Sparse:
        """From a column of Spark ML vectors, sparse or dense."""
        _, _, places, values = vectors.flatten()
        if not places.null_count and not values.null_count:  # all are sparse
            starts = np.concatenate([[0], np.cumsum(pc.list_value_length(values).to_numpy(zero_copy_only=False), dtype=np.int64)])
            return cls(starts, places.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy())
        held = values.to_numpy(zero_copy_only=False)
        sizes = np.array([len(v) for v in held], np.int64)
        at = [np.arange(len(v)) if p is None else p for p, v in zip(places.to_numpy(zero_copy_only=False), held)]
        joined = lambda parts, kind: np.concatenate(parts).astype(kind) if len(parts) else np.zeros(0, kind)
        return cls(np.concatenate([[0], np.cumsum(sizes)]), joined(at, np.int64), joined(held, np.float64))

    def blocks(self) -> Iterator[Block]:
        """Some rows at a time, cut into tiles of features that stand next to each other. A vocabulary begins with what is
        frequent, so entries crowd in the first tiles; these are multiplied as dense matrices, the rest by its entries."""
        first, n = 0, len(self.starts) - 1
        while first < n:
            last = max(first + 1, int(np.searchsorted(self.starts, self.starts[first] + ENTRIES, "right")) - 1)
            last = min(last, first + ROWS)
            a, b = self.starts[first], self.starts[last]
            row, tile = np.repeat(np.arange(last - first), np.diff(self.starts[first:last + 1])), self.places[a:b] // TILE
            crowded = np.bincount(tile) >= DENSE * TILE * (last - first)
            rest = ~crowded[tile] if len(tile) else np.zeros(0, bool)
            order = np.argsort(np.where(rest, len(crowded), tile), kind="stable")
            held = [x[order] for x in (row, self.places[a:b], self.values[a:b])]
            ends = np.cumsum(np.bincount(tile, minlength=len(crowded))[crowded], dtype=np.int64)
            parts = [tuple(x[i:j] for x in held) for i, j in zip([0, *ends], [*ends, len(order)])]
            yield Block(first, last, list(zip((np.flatnonzero(crowded) * TILE).tolist(), parts[:-1])), parts[-1])
            first = last

    def times(self, right: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.starts) - 1, right.shape[1]))
        for block in self.blocks():
            out[block.first:block.last] = block.times(right)
        return out

    def add_squared_times(self, right: np.ndarray, total: np.ndarray) -> None:
        """Adds these rows' transpose times them times ``right`` to ``total``."""
        for block in self.blocks():
            block.add_transpose_times(block.times(right), total)


@dataclass
class Block:
    """Rows ``first`` to ``last``: (first feature, entries) of each crowded tile, and the rest. Entries are (row here, feature,
    value), by row."""

    first: int
    last: int
    tiles: list[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]
    rest: tuple[np.ndarray, np.ndarray, np.ndarray]

    def dense(self, features: int) -> Iterator[tuple[slice, np.ndarray]]:
        for start, (row, place, value) in self.tiles:
            matrix = np.zeros((self.last - self.first, min(TILE, features - start)))
            matrix[row, place - start] = value
            yield slice(start, start + matrix.shape[1]), matrix

    def times(self, right: np.ndarray) -> np.ndarray:
        out = np.zeros((self.last - self.first, right.shape[1]))
        for tile, matrix in self.dense(len(right)):
            out += matrix @ right[tile]
        row, place, value = self.rest
        for i, a, b in _runs(row):
            out[i] += value[a:b] @ right[place[a:b]]
        return out

    def add_transpose_times(self, left: np.ndarray, total: np.ndarray) -> None:
        for tile, matrix in self.dense(len(total)):
            total[tile] += matrix.T @ left
        order = np.argsort(self.rest[1], kind="stable")
        row, place, value = (x[order] for x in self.rest)
        for i, a, b in _runs(place):
            total[i] += value[a:b] @ left[row[a:b]]


def _runs(numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(number, first, last) of equal numbers that follow each other."""
    first = np.flatnonzero(np.diff(numbers, prepend=-1))
    return zip(numbers[first].tolist(), first.tolist(), [*first[1:].tolist(), len(numbers)])


# Truncated SVD --------------------------------------------------------------------------------------------------------


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up (block, part) that come sorted by block."""
    now, total = None, None
    made = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "part"])
    for batch in batches:
        for block, part in zip(batch.column(0).to_pylist(), batch.column(1)):
            if block != now:
                if total is not None:
                    yield made()
                now, total = block, np.zeros(len(part.as_buffer()) // 8)
            total += np.frombuffer(part.as_buffer())
    if total is not None:
        yield made()


def _squared_times(rows: DataFrame, column: str, right: np.ndarray) -> np.ndarray:
    """rows' transpose times rows times ``right``."""
    sent, (features, width) = rows.sparkSession.sparkContext.broadcast(right), right.shape

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((features, width))
        for batch in batches:
            Sparse.of(batch.column(0)).add_squared_times(sent.value, total)
        for block, start in enumerate(range(0, features, BLOCK)):
            if (cut := total[start:start + BLOCK]).any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([cut.tobytes()], pa.binary())], names=["block", "part"])

    shares = rows.select(column).mapInArrow(share, "block int, part binary")
    out = np.zeros((features, width))
    for block, part in shares.repartition("block").sortWithinPartitions("block").mapInArrow(_sums, "block int, part binary").collect():
        out[block * BLOCK:(block + 1) * BLOCK] = np.frombuffer(part).reshape(-1, width)
    sent.unpersist()
    return out


def _triangle(rows: DataFrame, column: str, right: np.ndarray) -> np.ndarray:
    """R of the QR of rows times ``right``, by a tree of merges."""
    sent, width = rows.sparkSession.sparkContext.broadcast(right), right.shape[1]
    as_batch = lambda r: pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            r = np.linalg.qr(np.vstack([r, Sparse.of(batch.column(0)).times(sent.value)]), "r")
        if len(r):
            yield as_batch(r)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            for part in batch.column(0):
                r = np.linalg.qr(np.vstack([r, np.frombuffer(part.as_buffer()).reshape(-1, width)]), "r")
        if len(r):
            yield as_batch(r)

    n, found = rows.rdd.getNumPartitions(), rows.select(column).mapInArrow(first, "r binary")
    while n > FAN:
        n = -(-n // FAN)
        found = found.repartition(n).mapInArrow(merge, "r binary")
    parts = [np.frombuffer(p[0]).reshape(-1, width) for p in found.collect()]
    sent.unpersist()
    return np.linalg.qr(np.vstack(parts), "r") if parts else np.zeros((0, width))


def orthonormal(matrix: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns: by two triangles of the columns' products, which cost a few multiplications,
    or by a QR where columns are too close to each other for that."""
    for _ in range(2):
        try:
            lower = np.linalg.cholesky(matrix.T @ matrix)
        except np.linalg.LinAlgError:
            return np.linalg.qr(matrix)[0]
        if lower.diagonal().min() < 1e-5 * lower.diagonal().max():
            return np.linalg.qr(matrix)[0]
        matrix = matrix @ np.linalg.inv(lower).T
    return matrix


def truncated_svd(rows: DataFrame, column: str, features: int, components: int = 160, *, more: int = 10, iterations: int = 5, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, components as columns) of the vectors in ``column``. Each component's greatest loading is
    positive. ``more`` columns beyond the components and ``iterations`` make the last ones exact. There are as many as the
    rows have, if that is fewer."""
    rows = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)  # a task hands on features x width numbers, however few rows it has
    width = min(features, components + more, max(1, rows.count()))
    basis = orthonormal(np.random.default_rng(seed).normal(size=(features, width)))
    for _ in range(iterations):
        basis = orthonormal(_squared_times(rows, column, basis))
    _, values, turned = np.linalg.svd(_triangle(rows, column, basis), full_matrices=False)
    values, vectors = values[:components], (basis @ turned.T)[:, :components]
    kept = values > 1e-10 * max(values[0], 1e-300) if len(values) else np.zeros(0, bool)
    values, vectors = values[kept], vectors[:, kept]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]) if len(values) else 1
    return values, vectors * sign


# The layer ------------------------------------------------------------------------------------------------------------

Weights = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def first_weights(inputs: int, hidden: int, seed: int) -> Weights:
    """Uniform within sqrt(6 / (in + out)) for the hidden layer, sqrt(2 / (in + out)) for the output."""
    rng = np.random.default_rng(seed)
    a, b = np.sqrt(6 / (inputs + hidden)), np.sqrt(2 / (hidden + 1))
    return rng.uniform(-a, a, (inputs, hidden)), rng.uniform(-a, a, hidden), rng.uniform(-b, b, hidden), rng.uniform(-b, b, 1)


def chances(weights: Weights, x: np.ndarray) -> np.ndarray:
    w1, b1, w2, b2 = weights
    return 1 / (1 + np.exp(-np.clip(np.maximum(x @ w1 + b1, 0) @ w2 + b2, -500, 500)))


def gradients(weights: Weights, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums over rows, in one row of numbers: rows, log loss, then the gradients of the four weights."""
    w1, b1, w2, b2 = weights
    z = x @ w1 + b1
    a = np.maximum(z, 0)
    score = np.clip(a @ w2 + b2, -500, 500)
    loss = np.logaddexp(0, score) - y * score
    d2 = 1 / (1 + np.exp(-score)) - y
    d1 = np.where(z > 0, d2[:, None] * w2, 0.0)
    return np.concatenate([[len(x), loss.sum()], (x.T @ d1).ravel(), d1.sum(axis=0), a.T @ d2, [d2.sum()]])


class Adam:
    """Steps on the sums of a batch; ``decay`` is the weight of half the squared weights, without biases."""

    def __init__(self, weights: Weights, rate: float = 1e-3, decay: float = 1e-4, keep: tuple[float, float] = (0.9, 0.999)):
        self.rate, self.decay, self.keep, self.step = rate, decay, keep, 0
        self.mean, self.square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]

    def __call__(self, weights: Weights, sums: np.ndarray) -> tuple[Weights, float]:
        """The next weights, and the batch's loss before the step."""
        n, at, out = sums[0], 2, []
        loss = (sums[1] + 0.5 * self.decay * sum((w * w).sum() for w in (weights[0], weights[2]))) / n
        self.step += 1
        rate = self.rate * np.sqrt(1 - self.keep[1] ** self.step) / (1 - self.keep[0] ** self.step)
        for i, w in enumerate(weights):
            g = (sums[at:at + w.size].reshape(w.shape) + (self.decay * w if i in (0, 2) else 0)) / n
            at += w.size
            self.mean[i] = self.keep[0] * self.mean[i] + (1 - self.keep[0]) * g
            self.square[i] = self.keep[1] * self.square[i] + (1 - self.keep[1]) * g * g
            out.append(w - rate * self.mean[i] / (np.sqrt(self.square[i]) + 1e-8))
        return tuple(out), loss


def _dense(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _summed(rows: DataFrame, work) -> np.ndarray:
    """The sum of ``work(x, y)`` over all partitions, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                total = total + work(_dense(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(float))
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return sum(np.frombuffer(r[0]) for r in rows.select("x", "label").mapInArrow(run, "sums binary").collect())


#: Rows of the batches that one task takes, one after the other.
CHAIN = 1 << 16


def _chained(spark: SparkSession, files: list[list[str]], weights: Weights, adam: Adam) -> tuple[Weights, Adam, list[float]]:
    """A step for each batch, given by its files, in one task, which holds a batch at a time. The steps of Adam follow one
    another, so a job for each would only wait longer."""

    def run(taken: list[list[str]]) -> tuple[Weights, Adam, list[float]]:
        now, step, losses = *copy.deepcopy(sent.value), []  # a task that is run again starts from the same
        for paths in taken:
            sums = 0
            for path in paths:
                system, inside = file_system(path)
                with system.open_input_file(inside) as data:
                    for batch in pq.ParquetFile(data).iter_batches(columns=["x", "label"]):
                        sums = sums + gradients(now, _dense(batch.column("x")), batch.column("label").to_numpy(zero_copy_only=False).astype(float))
            now, loss = step(now, sums)
            losses.append(loss)
        return now, step, losses

    sent = spark.sparkContext.broadcast((weights, adam))
    found = spark.sparkContext.parallelize([files], 1).map(run).collect()[0]
    sent.unpersist()
    return found


def _chains(order: list[int], sizes: dict[int, int]) -> Iterator[list[int]]:
    """Batches in their order, cut where a chain would have more than ``CHAIN`` rows."""
    chain, rows = [], 0
    for b in order:
        if chain and rows + sizes[b] > CHAIN:
            yield chain
            chain, rows = [], 0
        chain.append(b)
        rows += sizes[b]
    if chain:
        yield chain


#: Rows of the training table that stand aside, as a batch.
HELD_OUT = -1


def dealt(rows: DataFrame, key: str, batch: int, seed: int, held_out: int = 10) -> DataFrame:
    """``rows`` with ``batch``: a hash of the key holds out one in ``held_out``, another deals the others into batches."""
    drawn = lambda name: F.xxhash64(F.lit(f"{seed}|{name}"), F.col(key).cast("string"))
    aside = F.pmod(drawn("held out"), F.lit(held_out)) == 0
    batches = max(1, round(rows.count() * (1 - 1 / held_out) / batch))
    return rows.withColumn("batch", F.when(aside, HELD_OUT).otherwise(F.pmod(drawn("batch"), F.lit(batches))).cast("int"))


@dataclass
class Trained:
    weights: Weights
    #: (epoch, loss, accuracy on held-out rows)
    history: list[tuple[int, float, float | None]] = field(default_factory=list)


def train(rows: DataFrame, inputs: int, *, hidden: int = 96, epochs: int = 18, batch: int = 256, rate: float = 1e-3, decay: float = 1e-4, patience: int = 3,
          tolerance: float = 1e-4, seed: int = 42) -> Trained:
    """One hidden layer with rectified units on rows (key, label, x)."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "batches")
    dealt(rows, "key", batch, seed).repartition("batch").write.partitionBy("batch").parquet(path)
    sizes = {r["batch"]: r["n"] for r in spark.read.parquet(path).groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = lambda b: spark.read.schema("label int, x array<double>").parquet(f"{path}/batch={b}")
    parts = defaultdict(list)
    for file in sorted(map(unquote, spark.read.parquet(path).inputFiles())):
        parts[int(file.rsplit("/batch=", 1)[1].split("/")[0])].append(file)
    aside, batches = table(HELD_OUT) if HELD_OUT in sizes else None, sorted(b for b in sizes if b != HELD_OUT)
    weights, order = first_weights(inputs, hidden, seed), np.random.default_rng(seed + 1)
    out, adam, best, idle = Trained(weights), Adam(weights, rate, decay), -np.inf, 0
    for epoch in range(epochs if batches else 0):
        total = 0.0
        for chain in _chains(order.permutation(batches).tolist(), sizes):
            if sizes[chain[0]] > CHAIN:  # a batch of that size is a chain of its own, worth many tasks
                weights, loss = adam(weights, _summed(table(chain[0]), lambda x, y: gradients(weights, x, y)))  # noqa: B023
                losses = [loss]
            else:
                weights, adam, losses = _chained(spark, [parts[b] for b in chain], weights, adam)
            total += sum(loss * sizes[b] for loss, b in zip(losses, chain))
        score = None
        if aside is not None:
            right = _summed(aside, lambda x, y: np.array([((chances(weights, x) >= 0.5) == y).sum()], float))  # noqa: B023
            score = float(right[0] / sizes[HELD_OUT])
            idle = 0 if score >= best + tolerance else idle + 1
        out.history.append((epoch, float(total / sum(sizes[b] for b in batches)), score))
        if score is None or score > best:
            best, out.weights = best if score is None else score, weights
        if idle > patience:
            break
    return out


# The model ------------------------------------------------------------------------------------------------------------


@dataclass
class LayeredModel:
    """Text to probability: term stages of Spark ML, then components, scale and layer."""

    stages: PipelineModel
    values: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: Weights
    history: list = field(default_factory=list)

    def probability(self, df: DataFrame) -> DataFrame:
        """``df`` with the probability of label 1."""
        sent = df.sparkSession.sparkContext.broadcast((self.vectors, self.mean, self.scale, self.weights))
        names = df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors, mean, scale, weights = sent.value
                found = chances(weights, (Sparse.of(batch.column(len(names))).times(vectors) - mean) / scale)
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], pa.array(found)], names=[*names, "probability"])

        scored = self.stages.transform(df).select(*[F.col(f"`{c}`") for c in names], "features")
        return scored.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "probability double"]))

    def _arrays(self) -> dict[str, np.ndarray]:
        return {"values": self.values, "vectors": self.vectors, "mean": self.mean, "scale": self.scale} | {f"weights{i}": w for i, w in enumerate(self.weights)}

    def save(self, spark: SparkSession, path: str) -> None:
        self.stages.write().overwrite().save(f"{path}/stages")
        rows = [(name, at, list(a.shape), a[at:at + BLOCK].tobytes()) for name, a in self._arrays().items() for at in range(0, max(1, len(a)), BLOCK)]
        spark.createDataFrame(rows, "name string, at int, shape array<int>, data binary").write.mode("overwrite").parquet(f"{path}/numbers")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LayeredModel:
        held: dict[str, list] = {}
        for r in spark.read.parquet(f"{path}/numbers").orderBy("name", "at").collect():
            held.setdefault(r["name"], []).append(r)
        arrays = {name: np.frombuffer(b"".join(r["data"] for r in rows)).reshape(rows[0]["shape"]) for name, rows in held.items()}
        return cls(PipelineModel.load(f"{path}/stages"), *(arrays[n] for n in ("values", "vectors", "mean", "scale")), tuple(arrays[f"weights{i}"] for i in range(4)))


def _moments(rows: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of rows of numbers; merged by task, so that no digits are lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                total = _merged(total, _of(_dense(batch.column(0))))
        if total[0]:
            yield pa.RecordBatch.from_arrays([pa.array([total[0]]), pa.array([np.concatenate(total[1:]).tolist()])], names=["n", "facts"])

    total = 0, 0.0, 0.0
    for n, facts in rows.select(column).mapInArrow(run, "n bigint, facts array<double>").collect():
        total = _merged(total, (n, *np.split(np.array(facts), 2)))
    sd = np.sqrt(total[2] / max(total[0], 1))
    return total[1], np.where(sd > 0, sd, 1.0)


def _of(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = x.mean(axis=0)
    return len(x), mean, ((x - mean) ** 2).sum(axis=0)


def _merged(a, b):
    n = a[0] + b[0]
    if not b[0]:
        return a
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + apart**2 * (a[0] * b[0] / n)


def fit_layers(stages: PipelineModel, rows: DataFrame, *, components: int = 160, hidden: int = 96, iterations: int = 5, seed: int = 42, **training) -> LayeredModel:
    """A model of rows (key, label, features), whose features ``stages`` make from a text."""
    rows = written(rows.select("key", F.col("label").cast("int").alias("label"), "features"), "features")
    features = next(s for s in stages.stages if hasattr(s, "vocabulary"))
    values, vectors = truncated_svd(rows, "features", len(features.vocabulary), components, iterations=iterations, seed=seed)
    if not len(values):
        raise ValueError("the texts have no features in common")
    sent = rows.sparkSession.sparkContext.broadcast(vectors)

    def mapped(column: int, made) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = made(batch.column(column))
                lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["key", "label", "x"])

        return run

    kinds = f"key {rows.schema['key'].dataType.simpleString()}, label int, x array<double>"
    projected = written(rows.mapInArrow(mapped(2, lambda v: Sparse.of(v).times(sent.value)), kinds), "projected")  # once, as rows are wide
    mean, scale = _moments(projected, "x")
    scaled = projected.mapInArrow(mapped(2, lambda x: (_dense(x) - mean) / scale if len(x) else np.zeros((0, len(mean)))), kinds)
    found = train(scaled, len(values), hidden=hidden, seed=seed, **training)
    return LayeredModel(stages, values, vectors, mean, scale, found.weights, found.history)
