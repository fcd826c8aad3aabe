"""LM scoring by a hidden Markov model over words.

Tokens are words (A-Z in lower case) and one end for each text. A state emits a class, a class emits a token: the
``OWN`` most frequent tokens are classes of their own, all others share a class with those of the same last two
bytes. Within a class a token has probability (c + 1) / (tokens + kinds + 1) from its count c in the training texts;
what is over belongs to unseen tokens. Baum-Welch learns transitions and class emissions from all training texts:
each task runs scaled forward and backward recursions over its texts, and expected counts are added up across tasks
in slices of classes. The scaled forward recursion gives a text's exact log10 probability.

Counts never come together: the ``FREQUENT`` tokens, found by their counts in single tasks, are counted by position
and broadcast (a bounded list, whatever the corpus); the rest, each less than a small share of all tokens, meet
their counts in a window by token. Texts are read twice, then only their token numbers are.

The states start from a mixture of ``STATES`` unigram models of about ``SEED_TEXTS`` training texts; this bounded
sample only breaks the symmetry of the states. Of a text only its counts by class leave the task.

Edge cases: null and empty texts are one end token; tokens outside the training texts get the mass of their class;
without training texts all counts are 0; a null id counts as an empty text in the fold; repeated rows are texts
each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import as_text, shared_dir, written

FOLDS, HELD_OUT = 7, 2
FREQUENT = 1 << 17
OWN = 1 << 13
SUFFIXES = 1 << 10
STATES = 8
ROUNDS = 3
SEED_TEXTS = 1500
SLICE = 128
#: Expected counts of a slice are added up in so many places first, as every task sends some.
SALTS = 32
#: Tokens of the texts that a recursion runs over at a time. Steps are as many as the longest text has tokens, so many
#: texts share the steps of a long one. Training keeps 4 bytes for each token and state.
STRETCH = 2_000_000
PRIOR = 50.0
CLASSES = OWN + SUFFIXES


def fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % folds


def suffix(token: bytes) -> int:
    return zlib.crc32(token[-2:]) % SUFFIXES


def _suffix_of(token: Column) -> Column:
    return (F.crc32(F.when(F.length(token) > 2, F.substring(token, -2, 2)).otherwise(token)) % SUFFIXES).cast("int")


def _heavy(frequent: int):
    """Tokens and counts of a task, without those that are rare in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        seen = 0

        def flush() -> pa.RecordBatch:
            least = max(1, seen // (4 * frequent))
            kept = [(t, n) for t, n in counts.items() if n > least]
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())], names=["token", "n"])

        for batch in batches:
            for data in batch.column(0):
                words = data.as_buffer().to_pybytes().lower().split()
                counts.update(words)
                seen += len(words)
                if len(counts) > 200_000:
                    yield flush()
                    counts, seen = Counter(), 0
        if counts:
            yield flush()

    return run


def _numbered(tokens, frequent: int):
    """(id, held_out, data) to the token numbers: 0 is the end, then the frequent tokens; a rare token has the
    number of its suffix after those, and is listed with its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {t: i + 1 for i, t in enumerate(tokens.value)}

        class Numbers(dict):
            def __missing__(self, token: bytes) -> int:
                return frequent + suffix(token)

        numbers = Numbers(known)
        for batch in batches:
            ids, rare, times = [], [], []
            for data in batch.column(2):
                words = data.as_buffer().to_pybytes().lower().split()
                number = np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
                others = Counter([words[k] for k in np.flatnonzero(number >= frequent).tolist()])
                ids.append(np.append(number, np.uint32(0)).astype(np.uint32).tobytes())
                rare.append(list(others))
                times.append(list(others.values()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(ids, pa.binary()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32()))],
                names=["id", "held_out", "ids", "rare", "times"])

    return run


def _position_counts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for group in stretches(np.frombuffer(ids.as_buffer(), np.uint32) for batch in batches for ids in batch.column(0)):
            total += np.bincount(np.concatenate(group), minlength=width)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["number", "n"])

    return run


class Texts:
    """Several sequences, longest first, so that those still running at a step are the first ones."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences])
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.flat = np.concatenate([sequences[i] for i in self.order])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.active = np.searchsorted(-self.lengths, -np.arange(self.lengths[0]), side="left")

    def at(self, step: int) -> np.ndarray:
        return self.starts[: self.active[step]] + step


def forward(texts: Texts, model: dict, keep: bool = False):
    """Natural log probability of each sequence (in the order given), and with ``keep`` the scaled alphas and scales."""
    emit, move = model["emit"], model["move"]  # class x state, state x state
    logs = np.zeros(len(texts.lengths))
    alphas = np.empty((len(texts.flat), emit.shape[1]), emit.dtype) if keep else None
    scales = np.empty(len(texts.flat), emit.dtype) if keep else None
    alpha = None
    for step, active in enumerate(texts.active):
        at = texts.starts[:active] + step
        seen = emit[texts.flat[at]]
        alpha = model["start"] * seen if alpha is None else (alpha[:active] @ move) * seen
        scale = alpha.sum(axis=1)
        alpha = alpha / scale[:, None]
        logs[:active] += np.log(scale)
        if keep:
            alphas[at], scales[at] = alpha, scale
    out = np.empty(len(logs))
    out[texts.order] = logs
    return (out, alphas, scales) if keep else out


def expected(texts: Texts, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts: starts, transitions, and emissions as class x state."""
    _, gammas, scales = forward(texts, model, keep=True)  # alphas, which become gammas from the end on
    emit, move = model["emit"], model["move"]
    moves = np.zeros_like(move)
    beta = np.ones((len(texts.lengths), move.shape[0]), emit.dtype)
    back = np.ascontiguousarray(move.T)
    steps = len(texts.active)
    later = texts.at(steps - 1)
    for step in range(steps - 2, -1, -1):
        n = len(later)
        at = texts.at(step)
        ahead = emit[texts.flat[later]]
        ahead *= beta[:n]
        ahead /= scales[later][:, None]
        moves += gammas[at[:n]].T @ ahead
        beta[:n] = ahead @ back
        gammas[at] *= beta[: len(at)]
        later = at
    emitted = np.stack([np.bincount(texts.flat, gammas[:, k], minlength=emit.shape[0]) for k in range(move.shape[0])], axis=1)
    return gammas[texts.starts].sum(axis=0, dtype=float), (moves * move).astype(float), emitted


def stretches(sequences: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for s in sequences:
        held.append(s)
        size += len(s)
        if size >= STRETCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def _expectations(model, class_of):
    """Token numbers to expected counts in slices: -1 has starts and transitions, slice k classes from k * SLICE on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, classes = {k: v.astype(np.float32) for k, v in model.value.items()}, class_of.value
        total = None
        for group in stretches(classes[np.frombuffer(ids.as_buffer(), np.uint32)] for batch in batches for ids in batch.column(0)):
            found = expected(Texts(group), m)
            total = found if total is None else tuple(a + b for a, b in zip(total, found))
        if total is None:
            return
        start, moves, emitted = total
        rows = [(-1, np.concatenate([start, moves.ravel()]))]
        rows += [(k, part.ravel()) for k in range(-(-len(emitted) // SLICE)) if (part := emitted[k * SLICE:(k + 1) * SLICE]).any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([v.tobytes() for _, v in rows], pa.binary())], names=["slice", "counts"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts = np.frombuffer(counts.as_buffer(), float)
            total[k] = total[k] + counts if k in total else counts.copy()
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["slice", "counts"])


def reestimated(start: np.ndarray, moves: np.ndarray, emitted: np.ndarray, unigram: np.ndarray) -> dict:
    states = len(start)
    emit = emitted + PRIOR * unigram[:, None]
    moves = moves + 1.0 / states
    return {"start": (start + 1.0 / states) / (start.sum() + 1), "move": moves / moves.sum(axis=1, keepdims=True), "emit": emit / emit.sum(axis=0)}


def _class_counts(class_of):
    """Token numbers of a text to its classes and how often it has each: at most CLASSES numbers, however long it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(class_of.value[np.frombuffer(ids.as_buffer(), np.uint32)], return_counts=True) for ids in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c.astype(np.int32).tobytes() for c, _ in found], pa.binary()), pa.array([n.astype(np.int64).tobytes() for _, n in found], pa.binary())], names=["classes", "counts"])

    return run


def seed_model(texts: list[tuple[np.ndarray, np.ndarray]], unigram: np.ndarray, states: int, rounds: int = 15) -> dict:
    """A start for Baum-Welch from (classes, counts) of texts: a mixture of unigram models of whole texts, begun at
    texts far from each other."""
    classes = len(unigram)
    emitted = np.zeros((classes, states))
    weights = np.ones(states)
    texts = [(c, n) for c, n in texts if n.sum() > 20]
    if texts:
        top = np.argsort(-unigram, kind="stable")[:1024]
        place = np.full(classes, -1)
        place[top] = np.arange(len(top))
        counts = np.zeros((len(texts), len(top)))
        for row, (c, n) in zip(counts, texts):
            inside = place[c] >= 0
            row[place[c[inside]]] = n[inside]
        unit = np.sqrt(counts) / np.sqrt(np.maximum(1, counts.sum(axis=1, keepdims=True)))
        chosen = [int(counts.sum(axis=1).argmax())]
        near = unit @ unit[chosen[0]]
        while len(chosen) < min(states, len(texts)):
            chosen.append(int(near.argmin()))
            near = np.maximum(near, unit @ unit[chosen[-1]])
        share = (counts[chosen] + 1) / (counts[chosen] + 1).sum(axis=1, keepdims=True)
        share = np.concatenate([share, np.repeat(share[:1], states - len(chosen), axis=0)])
        weight = np.full(states, 1 / states)
        for _ in range(rounds):
            logs = counts @ np.log(share).T + np.log(weight)
            logs -= logs.max(axis=1, keepdims=True)
            belongs = np.exp(logs)
            belongs /= belongs.sum(axis=1, keepdims=True)
            share = belongs.T @ counts + 0.5
            share /= share.sum(axis=1, keepdims=True)
            weight = (belongs.sum(axis=0) + 1) / (len(texts) + states)
        for (c, n), b in zip(texts, belongs):
            emitted[c] += n[:, None] * b
        weights = weight * len(texts)
    return reestimated(weights, np.eye(states) * 40 + 1, emitted, unigram)


def train(numbered: DataFrame, class_of: np.ndarray, unigram: np.ndarray, states: int, rounds: int) -> dict:
    """Baum-Welch over (rid, ids) of the training texts."""
    context = numbered.sparkSession.sparkContext
    # About SEED_TEXTS texts by a hash: what each task sends shrinks as tasks grow in number.
    share = min(1.0, SEED_TEXTS / max(1, numbered.count()))
    classes = context.broadcast(class_of)
    picked = numbered.filter(F.pmod(F.xxhash64("ids", "rid"), F.lit(1 << 30)) < int(share * (1 << 30))).select("ids")
    seeds = sorted((bytes(c), bytes(n)) for c, n in picked.mapInArrow(_class_counts(classes), "classes binary, counts binary").collect())
    model = seed_model([(np.frombuffer(c, np.int32), np.frombuffer(n, np.int64)) for c, n in seeds], unigram, states)
    for _ in range(rounds):
        step = context.broadcast(model)
        parts = numbered.select("ids").mapInArrow(_expectations(step, classes), "slice int, counts binary")
        salted = parts.repartition("slice", F.spark_partition_id() % SALTS).mapInArrow(_added, "slice int, counts binary")
        merged = salted.repartition("slice").mapInArrow(_added, "slice int, counts binary").collect()  # classes / SLICE rows
        start, moves, emitted = np.zeros(states), np.zeros((states, states)), np.zeros((len(unigram), states))
        for k, counts in merged:
            counts = np.frombuffer(counts, float)
            if k < 0:
                start, moves = start + counts[:states], moves + counts[states:].reshape(states, states)
            else:
                part = counts.reshape(-1, states)
                emitted[k * SLICE:k * SLICE + len(part)] += part
        if not merged:
            break
        model = reestimated(start, moves, emitted, unigram)
        step.unpersist()
    return model


def _scored(model, class_of, plus_one, outside):
    """(rid, id, held_out, ids) to what a text has without its rare tokens: log10 sums under base and model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, classes, counted, without = model.value, class_of.value, plus_one.value, outside.value
        for batch in batches:
            sequences = [np.frombuffer(ids.as_buffer(), np.uint32) for ids in batch.column(3)]
            logs = np.concatenate([forward(Texts([classes[s] for s in group]), m) for group in stretches(iter(sequences))])
            known = [int((counted[s] > 0).sum()) for s in sequences]
            base = [float(counted[s].sum()) for s in sequences]
            inside = [float(without[s].sum()) for s in sequences]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([len(s) for s in sequences], pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(logs / np.log(10) + np.array(inside))],
                names=["rid", "id", "held_out", "n_tokens", "known", "base", "model"])

    return run


def _most_frequent(heavy: DataFrame, most: int) -> list[bytes]:
    """At most ``most`` tokens from the most frequent on. A histogram of counts says from which count on they are few
    enough, so that only they are sent to the driver."""
    size = F.floor(F.log2("n") * 16)
    room, least = most, 1 << 30
    for k, n in sorted(heavy.groupBy(size.alias("k")).count().collect(), reverse=True):  # 16 x 63 rows at most
        if n > room:
            break
        room, least = room - n, k
    return [bytes(t) for _, t in sorted((-r["n"], r["token"]) for r in heavy.filter(size >= least).collect())]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, frequent: int = FREQUENT, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    spark = docs.sparkSession
    shared_dir(spark)
    context = spark.sparkContext
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), (fold(id_col, FOLDS) == HELD_OUT).alias("held_out"), as_text(text_col).alias("data"))
    heavy = rows.filter(~F.col("held_out")).select("data").mapInArrow(_heavy(frequent), "token binary, n bigint")
    tokens = _most_frequent(written(heavy.groupBy("token").agg(F.sum("n").alias("n")), "heavy"), frequent - 1)
    listed = context.broadcast(tokens)
    numbered = rows.mapInArrow(_numbered(listed, frequent), f"id {kind}, held_out boolean, ids binary, rare array<binary>, times array<int>")
    numbered = written(numbered.withColumn("rid", F.monotonically_increasing_id()), "numbered")
    training = numbered.filter(~F.col("held_out"))

    width = frequent + SUFFIXES
    counts = np.zeros(width, np.int64)
    for number, n in training.select("ids").mapInArrow(_position_counts(width), "number bigint, n bigint").groupBy("number").agg(F.sum("n")).collect():
        counts[number] = n  # width rows at most
    rare = numbered.select("rid", "held_out", F.explode(F.arrays_zip(F.col("rare").alias("token"), F.col("times").alias("n"))).alias("t"))
    same = Window.partitionBy("token")
    rare = rare.select("rid", F.col("t.token").alias("token"), F.col("t.n").alias("n"), F.when(F.col("held_out"), 0).otherwise(F.col("t.n")).alias("trained"))
    rare = rare.select("rid", "n", _suffix_of(F.col("token")).alias("suffix"), F.sum("trained").over(same).alias("c"), F.row_number().over(same.orderBy(F.lit(1))).alias("place"))
    rare = written(rare.select("rid", "n", "suffix", "c", (F.col("place") == 1).alias("one")), "rare")
    kinds = np.zeros(SUFFIXES, np.int64)
    for s, n in rare.filter("one AND c > 0").groupBy("suffix").count().collect():
        kinds[s] = n

    total = int(counts.sum())
    own = min(OWN, frequent)
    class_of = np.empty(width, np.int32)
    class_of[:own] = np.arange(own)
    class_of[own:frequent] = OWN
    for i in range(own, len(tokens) + 1):
        class_of[i] = OWN + suffix(tokens[i - 1])
    class_of[frequent:] = OWN + np.arange(SUFFIXES)
    kinds_in = np.bincount(class_of[:frequent], counts[:frequent] > 0, minlength=CLASSES) + np.concatenate([np.zeros(OWN), kinds])
    tokens_in = np.bincount(class_of, counts, minlength=CLASSES)
    vocabulary = int((counts[:frequent] > 0).sum() + kinds.sum())
    unigram = (tokens_in + 1) / (tokens_in + 1).sum()
    model = train(training, class_of, unigram, states, rounds)

    plus_one = np.where(np.arange(width) < frequent, np.log10(counts + 1.0), 0.0)
    inside = np.where(np.arange(width) < frequent, plus_one, 0.0) - np.log10(tokens_in + kinds_in + 1)[class_of]
    inside[:own] = 0.0
    shared = [context.broadcast(x) for x in (model, class_of, plus_one, inside)]
    texts = numbered.select("rid", "id", "held_out", "ids").mapInArrow(
        _scored(*shared), f"rid bigint, id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, model double")
    sums = rare.groupBy("rid").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    joined = texts.join(sums, "rid", "left")
    log = F.coalesce("log", F.lit(0.0))
    return joined.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + log - F.col("n_tokens") * F.lit(float(np.log10(total + vocabulary + 1)))).alias("base_score"),
        (F.col("model") + log).alias("score"))
