"""Samples by hashed order: the same rows are drawn in any partitioning, and a sample with another seed is another."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import sums_before

SEED = 20260609
#: Seeds of the test sample, the calibration sample, and the training and validation examples.
SEEDS = {"test": SEED, "calibration": SEED + 1, "train": SEED + 10, "valid": SEED + 11}


def draw(seed: int, key: str = "id") -> Column:
    """The place of a row in the shuffled order of ``seed``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


def shuffled(df: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """All rows with their place in the shuffled order. Keys that are equal follow each other."""
    drawn = df.withColumn("_draw", draw(seed, key))
    return sums_before(drawn, ["_draw", key], {"sample_order": F.lit(1)}).drop("_draw")


def balanced(df: DataFrame, rows: int, seed: int, *, label: str = "label", key: str = "id", exclude: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """``rows`` // 2 rows of label 1 and the others of label 0, shuffled. Each class is drawn by a top-k, which keeps
    k rows a task and never sorts the whole class. A strict call fails where a class is too small."""
    if exclude is not None:
        df = df.join(exclude.select(key).distinct(), key, "left_anti")
    wanted = {1: rows // 2, 0: rows - rows // 2}
    parts = [df.filter(F.col(label) == value).orderBy(draw(seed, key), key).limit(n) for value, n in wanted.items()]
    if strict:
        for (value, n), part in zip(wanted.items(), parts):
            if (got := part.count()) < n:
                raise ValueError(f"label {value} has {got} rows, {n} are asked for")
    return shuffled(parts[0].unionByName(parts[1]), seed, key)


#: Shares of ids that a model is fitted on, that its threshold is chosen on, and that it is reported on.
PARTS = (("fit", 0.8), ("calibrate", 0.1), ("test", 0.1))


def grouped_split(df: DataFrame, key: str = "id", shares: tuple[tuple[str, float], ...] = PARTS, seed: int = SEED) -> DataFrame:
    """``df`` with ``part``. The part hangs on the key's draw alone: all rows of a key are on one side, and no key changes
    sides when rows are added."""
    place = F.conv(F.substring(draw(seed, key), 1, 8), 16, 10).cast("double") / 2**32
    part, up = None, 0.0
    for name, share in shares[:-1]:
        up += share
        part = F.when(place < up, name) if part is None else part.when(place < up, name)
    part = F.lit(shares[-1][0]) if part is None else part.otherwise(shares[-1][0])
    return df.withColumn("part", part)


def per_group(df: DataFrame, group: str, most: int, seed: int, key: str = "id") -> DataFrame:
    """At most ``most`` rows of each group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(draw(seed, key), key))
    return df.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")


def batches(df: DataFrame, size: int, *, group: str = "variant", order: str = "sample_order") -> DataFrame:
    """Batch numbers from 1 within each group, and the batch's file name."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    numbered = df.withColumn("batch", (F.floor(place / size) + 1).cast("int"))
    return numbered.withColumn("batch_file", F.format_string("%s_batch_%02d", F.col(group), F.col("batch")))


def ui_subset(aligned: DataFrame, rows: int = 50, size: int = 25) -> DataFrame:
    """The first hate rows and, up to ``rows``, non-hate rows of each variant, in sample order and batches."""
    place = F.row_number().over(Window.partitionBy("variant", "label").orderBy("sample_order"))
    placed = aligned.withColumn("_place", place)
    hate = F.least(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).over(Window.partitionBy("variant")), F.lit(rows // 2))
    chosen = placed.withColumn("_hate", hate).filter(F.col("_place") <= F.when(F.col("label") == 1, F.lit(rows // 2)).otherwise(rows - F.col("_hate")))
    return batches(chosen.drop("_place", "_hate"), size)


def overlaps(parts: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """(left_part, right_part, shared) for each pair of parts, from one grouping of all ids."""
    names = list(parts)
    tagged = [df.select(F.col(key).alias("id"), F.lit(name).alias("part")) for name, df in parts.items()]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    held = every.groupBy("id").agg(F.collect_set("part").alias("parts"))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    counts = held.agg(*[F.count(F.when(F.array_contains("parts", a) & F.array_contains("parts", b), 1)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("left_part"), F.lit(b).alias("right_part"), F.col(f"c{i}").alias("shared")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


#: The variants that training examples are made from.
EXAMPLE_VARIANTS = ("clean", "romanized_35", "roman_glyph_35")


def training_examples(aligned: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Chat examples of the rows (id, variant, text, normalized_text, label) in the training variants, without the
    ids of ``exclude``."""
    from ..functions.labels import messages

    rows = aligned.filter(F.col("variant").isin(*EXAMPLE_VARIANTS))
    if exclude is not None:
        rows = rows.join(exclude.select("id").distinct(), "id", "left_anti")
    return rows.withColumn("messages", messages(F.col("text"), F.col("normalized_text"), digits=True, answer=F.col("label")))


def with_token_counts(examples: DataFrame, counter=None) -> DataFrame:
    """Adds token_count, over all turns of ``messages``, and supervised_token_count, of the last turn (the answer).
    ``counter`` makes, once a task, a function from a text to its number of tokens; without one, words count."""
    if counter is None:
        size = lambda turn: F.regexp_count(turn["content"], F.lit(r"[^\x20\x09-\x0D]+"))
        total = F.reduce("messages", F.lit(0), lambda n, turn: n + size(turn))
        return examples.withColumn("token_count", total).withColumn("supervised_token_count", size(F.element_at("messages", -1)))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in examples.schema.fields)
    texts = examples.withColumn("_contents", F.transform("messages", lambda turn: turn["content"]))

    def run(batches):
        count = counter()
        for batch in batches:
            sizes = [[count(t) for t in contents] for contents in batch.column("_contents").to_pylist()]
            made = [pa.array([sum(s) for s in sizes], pa.int32()), pa.array([s[-1] for s in sizes], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "token_count", "supervised_token_count"])

    return texts.mapInArrow(run, f"{columns}, token_count int, supervised_token_count int")
