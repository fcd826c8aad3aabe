"""N-gram Jaccard join by chosen paths.

A document is the set of its 5-word shingles. In each of ``RUNS`` runs the sets are split on a sampled token: the one
that is smallest under a random order, which two sets share with a probability equal to their similarity. A bucket
of more than ``LIMIT`` sets or ``MOST_TOKENS`` shingles is split again on the next token of its path, down to
``DEPTH`` levels; small buckets are compared by brute force. Two sets meet in a run with probability similarity **
depth, so with n runs a pair at the threshold is missed with probability (1 - 0.8 ** depth) ** n. Two sets of which
one was in no split bucket have a depth of one. For the others, rounds of further runs follow until this, with the
deepest level that any bucket reached, is at most 1 - ``RECALL``; there is no other end to the rounds.

Only heavy buckets are looked up below the first level: there is at most one for ``LIMIT`` rows, and the rows of a
level meet them in one outer join. What meets none is a leaf.

Brute force goes in two steps. Sketches (a byte of each of 48 tokens) rule out most pairs; the documents left ship
their whole sets, and the pairs left are counted exactly, over bits of the shingles that each cluster of them shares.
A pair that meets in several runs is compared in the first only. Buckets return a row for each document (its links,
and the smallest document it hangs together with), never pairs, so a dense group costs rows in proportion to its
size. A bucket that stays too large at the last level is cut into chunks and every pair of chunks is compared: nothing
is dropped. Equal texts are one set with a number of copies. Classes are the connected components of the links.

Edge cases: a text of fewer than five words has one shingle, all its words; a null or empty text has none, links to
nothing and is a class of its own; repeated rows are copies; a null id takes part and is never a class id unless all
ids of the class are null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rolling import WordHashes, mixed, windows
from .shared import drop_written, keyed, shared_dir, written

SHINGLE = 5
THRESHOLD = 0.8
RUNS = 10
DEPTH = 6
LIMIT = 4096
#: Shingles in a bucket that is compared in one place: 32 MB of them.
MOST_TOKENS = 4 << 20
RECALL = 0.999
#: Sampled tokens of a set that its sketch has a byte of. Paths have tokens of their own for each run and level.
TOKENS = 48
#: A pair is compared exactly when so many of the sketches' bytes agree: 38.4 are expected at the threshold, with a
#: standard deviation of 2.8.
AGREE = 25


def orders(first_run: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """``count`` random orders; those of each round of runs are drawn anew."""
    random = np.random.RandomState(20240607 + first_run)
    flip = random.randint(0, 1 << 62, count).astype(np.uint64)
    return flip, (random.randint(0, 1 << 62, count).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def shingles(words: list[bytes], hashes: WordHashes, shingle: int) -> np.ndarray:
    """Sorted hashes of the set."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    if len(h) < shingle:  # all the words; their number tells them from a longer run
        return mixed(windows(h, len(h)) ^ np.uint64(len(h)))
    return np.unique(windows(h, shingle))


def smallest(tokens: np.ndarray, flip: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The sampled tokens: for each random order its smallest value."""
    out = np.empty(len(flip), np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(flip), 8):
            x = (tokens[None, :] ^ flip[a:a + 8, None]) * times[a:a + 8, None]
            out[a:a + 8] = (x ^ (x >> np.uint64(32))).min(axis=1)
    return out


def _lists(rows: list[np.ndarray], count: int) -> pa.ListArray:
    """Equally long rows of tokens."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * count, pa.int32()), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64)))


def _signatures(shingle: int, paths: int):
    """(r, d1, d2, data) to (r, d1, d2, n, tokens, sketch), with the ``paths`` tokens of the first runs."""
    count = max(TOKENS, paths)
    flip, times = orders(0, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, tokens, sketches, rows = [], [], [], []
            for i, data in enumerate(batch.column(3)):
                found = shingles(data.as_buffer().to_pybytes().split(), hashes, shingle)
                if len(found):
                    least = smallest(found, flip, times)
                    rows.append(i)
                    sizes.append(len(found))
                    tokens.append(least.view(np.int64))
                    sketches.append(mixed(least[:TOKENS]).astype(np.uint8).tobytes())
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:3], pa.array(sizes, pa.int64()), _lists(tokens, count), pa.array(sketches, pa.binary())], names=["r", "d1", "d2", "n", "tokens", "sketch"])

    return run


def _more_tokens(shingle: int, first_run: int, paths: int):
    """(rid, data) to (rid, tokens): the ``paths`` tokens of the runs from ``first_run`` on."""
    flip, times = orders(first_run, paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            tokens = [smallest(shingles(data.as_buffer().to_pybytes().split(), hashes, shingle), flip, times).view(np.int64) for data in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(tokens, paths)], names=["rid", "tokens"])

    return run


def leaves(sets: DataFrame, first_run: int, runs: int, limit: int, most_tokens: int, depth: int) -> tuple[DataFrame, list[DataFrame]]:
    """(rid, run, leaf, part, side, whole, level) for each set and run whose first bucket holds another set, and the
    written tables it reads. ``part`` is what is compared in one place: the leaf, or two chunks of one that stayed too
    large."""

    def chosen(level: int) -> Column:
        """The token that a run splits on at ``level``; no other run or level has its order."""
        return F.get("tokens", (F.col("run") - first_run) * depth + level)

    heavy = (F.col("count") > limit) | (F.col("total") > most_tokens)
    sizes = (F.count(F.lit(1)).alias("count"), F.sum("n").alias("total"))
    every = sets.select("rid", "n", "tokens", F.explode(F.sequence(F.lit(first_run), F.lit(first_run + runs - 1))).alias("run"))
    rows = every.select("rid", "n", "run", F.xxhash64("run", chosen(0)).alias("key"))
    counted = written(rows.join(rows.groupBy("key").agg(*sizes).filter("count > 1"), "key"), "buckets")
    tables, done = [counted], []
    rest, level = counted.filter(heavy), 1
    done.append((counted.filter(~heavy), level))
    if depth > 1 and not rest.isEmpty():  # the rest of the path comes along, so that sets are met once
        split = rest.groupBy("rid", "n").agg(F.collect_list(F.struct("run", "key")).alias("runs")).join(sets.select("rid", "tokens"), "rid")
        split = split.select("rid", "n", "tokens", F.explode("runs").alias("s")).select("rid", "n", "tokens", "s.run", "s.key")
        rest = split.withColumn("path", F.array(*[chosen(k) for k in range(1, depth)])).drop("tokens")
    while level < depth and not rest.isEmpty():
        rows = written(rest.select("rid", "n", "run", "path", F.xxhash64("key", F.get("path", F.lit(level - 1))).alias("key")), "paths")
        crowds = written(rows.groupBy("key").agg(*sizes).filter(heavy), "heavy")
        tables += [rows, crowds]
        level += 1
        looked_up = rows.join(crowds, "key", "left")
        if crowds.isEmpty():
            done.append((looked_up, level))
            break
        looked_up = written(looked_up, "buckets")
        tables.append(looked_up)
        done.append((looked_up.filter("count IS NULL"), level))
        rest = looked_up.filter("count IS NOT NULL")
    else:
        done.append((rest, level))  # still too large
    found = [rows.select("rid", "run", F.col("key").alias("leaf"), "count", "total", F.lit(at).alias("level")) for rows, at in done]
    cut = functools.reduce(DataFrame.unionByName, found)
    crowded = F.coalesce(heavy, F.lit(False))
    chunks = F.greatest(F.ceil(F.col("count") / max(1, limit // 2)), F.ceil(F.col("total") / max(1, most_tokens // 2))).cast("int")
    side = F.when(crowded, F.pmod(F.xxhash64("rid"), chunks).cast("int")).otherwise(F.lit(0))
    others = F.when(crowded, F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(F.lit(0)))
    cut = cut.withColumn("side", side).withColumn("other", F.explode(others))
    part = F.xxhash64("leaf", F.least("side", "other"), F.greatest("side", "other"))
    return cut.select("rid", "run", "leaf", "level", part.alias("part"), "side", (F.col("side") == F.col("other")).alias("whole")), tables


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows with the same first column; the input is sorted by it."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


#: Rows of a bucket that are held against all of it at once.
BLOCK = 256


def candidates(rows: list[tuple], threshold: float, agree: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (places i < j in ``rows``) to compare exactly here: alike by sketch and size, met in no earlier run, and of
    two chunks those across. ``rows`` begin with part, run, rid, side, whole, n, sketch, met."""
    n = np.array([r[5] for r in rows], float)
    sketch = np.ascontiguousarray(np.frombuffer(b"".join(r[6] for r in rows), np.uint8).reshape(len(rows), TOKENS).T)
    met = np.frombuffer(b"".join(r[7] for r in rows), np.int64).reshape(len(rows), -1)
    side, run, whole = np.array([r[3] for r in rows]), rows[0][1], rows[0][4]
    firsts, seconds = [], []
    for a in range(0, len(rows), BLOCK):
        same = np.zeros((min(BLOCK, len(rows) - a), len(rows) - a), np.uint8)
        for k in range(TOKENS):
            same += sketch[k, a:a + BLOCK, None] == sketch[k, None, a:]
        i, j = np.nonzero(np.triu(same >= agree, 1))
        i, j = i + a, j + a
        fits = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9
        if not whole:
            fits &= side[i] != side[j]
        for r in range(run):
            fits &= (met[i, r] != met[j, r]) | (met[i, r] == 0)
        firsts.append(i[fits])
        seconds.append(j[fits])
    return np.concatenate(firsts), np.concatenate(seconds)


def _plausible(threshold: float, agree: int):
    """(part, run, rid, side, whole, n, sketch, met, copies): the rows with a plausible partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in _groups(batches):
            if len(rows) < 2:
                continue
            out += [rows[i] for i in np.unique(np.concatenate(candidates(rows, threshold, agree))).tolist()]
            if len(out) > 4096:
                yield _rows(out, PLAUSIBLE)
                out = []
        if out:
            yield _rows(out, PLAUSIBLE)

    return run


PLAUSIBLE = (("part", pa.int64()), ("run", pa.int32()), ("rid", pa.int64()), ("side", pa.int32()), ("whole", pa.bool_()), ("n", pa.int64()), ("sketch", pa.binary()), ("met", pa.binary()), ("copies", pa.int64()))
WITH_SETS = (*PLAUSIBLE, ("tokens", pa.binary()))
LINKED = (("rid", pa.int64()), ("label", pa.int64()), ("links", pa.int64()))


def _rows(rows: list[tuple], columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, (_, kind) in zip(zip(*rows), columns)], names=[name for name, _ in columns])


def _schema(columns) -> str:
    names = {"int64": "bigint", "int32": "int", "bool": "boolean", "binary": "binary"}
    return ", ".join(f"{name} {names[str(kind)]}" for name, kind in columns)


def _with_sets(shingle: int):
    """(rid, n, sketch, met, copies, places, data) to a row for each place, with the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for rid, n, sketch, met, copies, places, data in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = shingles(data.split(), hashes, shingle).tobytes()
                for p in places:
                    out.append((p["part"], p["run"], rid, p["side"], p["whole"], n, sketch, met, copies, tokens))
                    held += len(tokens)
                    if held > 8 << 20:
                        yield _rows(out, WITH_SETS)
                        out, held = [], 0
            if out:
                yield _rows(out, WITH_SETS)

    return run


def least_labels(i: np.ndarray, j: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The smallest label that each place hangs together with over the pairs (i, j)."""
    out = labels
    while True:
        new = out.copy()
        np.minimum.at(new, i, out[j])
        np.minimum.at(new, j, out[i])
        if (new == out).all():
            return out
        out = new


def common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets of the pairs (i, j): bits of the tokens that several sets have."""
    if len(i) == 1:
        return np.array([len(np.intersect1d(sets[i[0]], sets[j[0]], assume_unique=True))])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1  # tokens in one set meet nothing
    column = np.where(shared, np.cumsum(shared) - 1, -1)[token]
    step = max(64, min(1 << 15, (32 << 20) // len(sets)) & ~63)
    out = np.zeros(len(i), np.int64)
    for a in range(0, int(shared.sum()), step):
        inside = (column >= a) & (column < a + step)
        bits = np.zeros((len(sets), step), bool)
        bits[owner[inside], column[inside] - a] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        pairs = max(1, (1 << 21) // words.shape[1])
        for b in range(0, len(i), pairs):
            out[b:b + pairs] += np.bitwise_count(words[i[b:b + pairs]] & words[j[b:b + pairs]]).sum(axis=1, dtype=np.int64)
    return out


def linked(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have a similarity at the threshold or above. Pairs that hang together are counted together."""
    cluster = least_labels(i, j, np.arange(len(sets)))[i]
    order = np.argsort(cluster, kind="stable")
    out = np.zeros(len(i), bool)
    for these in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
        members, place = np.unique(np.concatenate([i[these], j[these]]), return_inverse=True)
        held = [sets[m] for m in members.tolist()]
        n = np.array([len(h) for h in held], float)
        x, y = place[:len(these)], place[len(these):]
        inter = common(held, x, y)
        out[these] = inter >= threshold * (n[x] + n[y] - inter) - 1e-9
    return out


def _verify(threshold: float, agree: int):
    """Rows with whole sets, by part, to (rid, label, links)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in _groups(batches):
            if len(rows) < 2:
                continue
            i, j = candidates(rows, threshold, agree)
            if not len(i):
                continue
            yes = linked([np.frombuffer(r[9], np.uint64) for r in rows], i, j, threshold)
            i, j = i[yes], j[yes]
            rid, copies, links = np.array([r[2] for r in rows]), np.array([r[8] for r in rows]), np.zeros(len(rows), np.int64)
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            label = least_labels(i, j, rid)
            out += list(zip(rid[links > 0].tolist(), label[links > 0].tolist(), links[links > 0].tolist()))
            if len(out) > 4096:
                yield _rows(out, LINKED)
                out = []
        if out:
            yield _rows(out, LINKED)

    return run


def _by_part(rows: DataFrame) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part")


def _texts(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The sets ``asked``, which have r, d1 and d2, with their texts. A row repeated with its id has the same key twice
    and gives its set twice."""
    asked = asked.withColumnsRenamed({"r": "e", "d1": "e1", "d2": "e2"})
    rows = keyed(docs, id_col, text_col)
    return rows.join(asked, (F.col("r") == F.col("e")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")))


def _links(docs: DataFrame, sets: DataFrame, texts: DataFrame | None, found: DataFrame, first: int, runs: int, repeats: bool, id_col: str, text_col: str, shingle: int, threshold: float, agree: int) -> DataFrame:
    """(rid, label, links) of the runs from ``first`` on; ``found`` has the buckets of these and all earlier runs, and
    ``texts`` the texts of the sets that take part where they have been written."""
    in_order = F.transform(F.sequence(F.lit(0), F.lit(first + runs - 1)), lambda r: F.coalesce(F.element_at("by_run", r.cast("int")), F.lit(0)))
    mine = found.groupBy("rid").agg(
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct("run", "leaf")))).alias("by_run"),
        F.collect_list(F.when(F.col("run") >= first, F.struct("part", "run", "side", "whole"))).alias("places"))  # one for each run and chunk
    mine = mine.filter(F.size("places") > 0).select("rid", "places", in_order.alias("met"))
    met = F.unhex(F.array_join(F.transform("met", lambda x: _little_endian(x)), ""))
    rows = mine.join(sets.select("rid", "n", "sketch", "copies"), "rid").select("rid", "n", "sketch", "copies", met.alias("met"), F.explode("places").alias("p"))
    rows = rows.select("p.part", "p.run", "rid", "p.side", "p.whole", "n", "sketch", "met", "copies")
    plausible = written(_by_part(rows).mapInArrow(_plausible(threshold, agree), _schema(PLAUSIBLE)), "plausible")
    asked = plausible.groupBy("rid", "n", "sketch", "met", "copies").agg(F.collect_list(F.struct("part", "run", "side", "whole")).alias("places"))
    if texts is None:
        texts = _texts(docs, asked.join(sets.select("rid", "r", "d1", "d2"), "rid"), id_col, text_col)
    else:
        texts = texts.join(asked, "rid")
    whole = texts.select("rid", "n", "sketch", "met", "copies", "places", "data").mapInArrow(_with_sets(shingle), _schema(WITH_SETS))
    whole = whole.dropDuplicates(["part", "rid"]) if repeats else whole
    links = written(_by_part(whole).mapInArrow(_verify(threshold, agree), _schema(LINKED)), "links")
    drop_written(plausible)
    return links


def sketches_miss(threshold: float, agree: int) -> float:
    """The probability that fewer than ``agree`` of the sampled tokens of a pair at the threshold are the same."""
    return sum(math.comb(TOKENS, k) * threshold ** k * (1 - threshold) ** (TOKENS - k) for k in range(agree))


def missed(threshold: float, agree: int, deepest: int, runs: int) -> float:
    """At most so probable is the loss of a pair at the threshold whose buckets are ``deepest`` levels deep."""
    return (1 - threshold ** deepest) ** runs + sketches_miss(threshold, agree)


def _little_endian(x: Column) -> Column:
    digits = F.lpad(F.hex(x), 16, "0")
    return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(8))])


def one_of_each(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with its columns, that stay when one row of each class does: the first as it is read.
    Rows without a shingle (null or empty texts) are classes of their own and all stay."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    first = similar(numbered, row, text_col, **options).filter(F.col(row) == F.col("class_id")).select(row)
    return numbered.join(first, row, "left_semi").drop(row)


def components(edges: DataFrame) -> DataFrame:
    """(rid, root) from (rid, label): label propagation with shortcuts; each round is written, and rounds go with the
    logarithm of a component's width."""
    edges = written(edges.filter("rid != label").select("rid", "label").distinct(), "edges")
    both = edges.unionByName(edges.select(F.col("label").alias("rid"), F.col("rid").alias("label")))
    roots = written(both.groupBy("rid").agg(F.least(F.min("label"), F.col("rid")).alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("rid").alias("label"), "root"), "label").groupBy("rid").agg(F.min("root").alias("near"))
        step = roots.join(near, "rid").select("rid", F.least("root", "near").alias("to"), F.col("root").alias("was"))
        jump = step.select(F.col("rid").alias("to"), F.col("to").alias("beyond"))
        new = step.join(jump, "to", "left").select("rid", F.least("to", F.coalesce("beyond", "to")).alias("root"), "was")
        new = written(new, "roots")
        drop_written(roots)
        if new.filter("root != was").isEmpty():
            return new.select("rid", "root")
        roots = new.select("rid", "root")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, threshold: float = THRESHOLD, runs: int = RUNS,
            limit: int = LIMIT, most_tokens: int = MOST_TOKENS, depth: int = DEPTH, recall: float = RECALL, agree: int = AGREE) -> DataFrame:
    """One row for each row of ``docs``: id, class_id (the smallest id of its class), class_size and n_links (other
    rows at the threshold or above). ``docs`` is read a few times and has to give the same rows."""
    if sketches_miss(threshold, agree) >= 1 - recall:
        raise ValueError(f"sketches that agree in {agree} of {TOKENS} bytes do not reach a recall of {recall} at {threshold}")
    shared_dir(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    one_of = rows.groupBy("d1", "d2").agg(F.min("r").alias("e"), F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.count(F.when(F.col("id").isNull(), 1)).alias("nulls"))
    signed = rows.select("r", "d1", "d2", "data").mapInArrow(_signatures(shingle, runs * depth), "r bigint, d1 bigint, d2 bigint, n bigint, tokens array<bigint>, sketch binary")
    one_of = one_of.withColumnsRenamed({"d1": "e1", "d2": "e2"})
    twins = signed.join(one_of, (F.col("r") == F.col("e")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))).drop("e", "e1", "e2")
    sets, repeats = _one_each(twins)
    pending, first, deepest, parts, met, crowded, texts = sets, 0, 1, [], None, None, None
    while True:
        found, tables = leaves(pending, first, runs, limit, most_tokens, depth)
        found = written(found, "leaves")
        drop_written(*tables)
        met = found if met is None else met.unionByName(found)
        parts.append(_links(docs, sets, texts, met, first, runs, repeats, id_col, text_col, shingle, threshold, agree))
        first += runs
        deepest = max(deepest, found.agg(F.max("level")).first()[0] or 1)
        split = found.filter("level > 1").select("rid")
        crowded = written((split if crowded is None else split.unionByName(crowded)).distinct(), "crowded")
        if missed(threshold, agree, deepest, first) <= 1 - recall:
            break
        alone = missed(threshold, agree, 1, first) <= 1 - recall  # enough runs for sets in no split bucket
        if texts is None:
            asked = sets.join(crowded, "rid", "left_semi") if alone else sets
            texts = _texts(docs, asked.select("rid", "r", "d1", "d2"), id_col, text_col).select("rid", "data")
            texts = written(texts.dropDuplicates(["rid"]) if repeats else texts, "texts")
        fresh = texts.join(crowded, "rid", "left_semi") if alone else texts
        if pending is not sets:
            drop_written(pending)
        pending = fresh.mapInArrow(_more_tokens(shingle, first, runs * depth), "rid bigint, tokens array<bigint>")
        pending = written(pending.join(sets.select("rid", "n"), "rid"), "tokens")
    linked = written(functools.reduce(DataFrame.unionByName, parts), "linked")
    drop_written(*parts, met, texts, None if pending is sets else pending)
    roots = components(linked)
    counted = linked.groupBy("rid").agg(F.sum("links").alias("links"))
    classes = sets.select("rid", "d1", "d2", "copies", "least_id").join(counted, "rid", "left").join(roots, "rid", "left")
    classes = classes.select("d1", "d2", "copies", "least_id", F.coalesce("root", "rid").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    named = classes.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"))
    classes = written(classes.join(named, "root").select("d1", "d2", "class_id", "class_size", (F.col("links") + F.col("copies") - 1).alias("n_links")), "classes")
    drop_written(sets, linked, roots)
    light = rows.select("id", "d1", "d2").join(classes, ["d1", "d2"], "left")
    alone = F.col("class_size").isNull()
    return light.select(
        F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _one_each(twins: DataFrame) -> tuple[DataFrame, bool]:
    """Numbers the sets; and whether rows are repeated with their id, which gives a set more than once: then one of
    each is taken."""
    key = ["r", "d1", "d2"]
    rows = written(twins.withColumn("rid", F.monotonically_increasing_id()), "sets")
    if rows.groupBy(*key).agg(F.count(F.lit(1)).alias("twins")).filter("twins > 1").isEmpty():
        return rows, False
    once = written(rows.dropDuplicates(key), "sets")
    drop_written(rows)
    return once, True
