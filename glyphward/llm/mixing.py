"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Targets: ``share`` of all sizes is shared out by weight, no source above ``most`` times its own size; what a capped
source leaves is shared out again by weight until no source is above its cap. That fixed point is found at once:
ordered by cap / weight, the capped sources are a prefix.

Sampling: a document of a source is expected ``target / source_size`` times. The expected copies are summed up
within the source in a fixed order, one offset is added, and a copy is made for each integer that the running sum
crosses. The order goes by classes of size, so the words taken follow the target closely, and within a class by a
hash. The prefix sum is made in three levels (rows of a bucket of hashes, buckets of a class, classes of a source);
so a source with any share of all rows is spread over (classes x buckets) groups, and only counts cross levels.

Edge cases: a null or empty text has size 0 and its copies take 0 words; a null source is a source of its own, the
last one; with no words at all every target is 0 and nothing is taken; repeated rows are documents each; an empty
table gives an empty result; columns of the input that clash with new ones are
replaced in the plan and stay as they are in the mix. The same rows give the
same copies in any partitioning and order of columns, because order and offset come from digests of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_dir, word_count, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Hash buckets of each size class of a source: at least so many, and one for each so many rows of the table, so that no
#: bucket outgrows a task even where one class holds all rows.
BUCKETS = 256
ROWS_A_BUCKET = 1 << 20
MADE = ("size", "source_size", "target", "copies", "taken")


def _digest(*values: Column) -> Column:
    """MD5 of the values' texts, which SQL has too; nulls are left out."""
    return F.md5(F.concat_ws("|", *[v.cast("string") for v in values]).cast("binary"))


def _number(digits: Column) -> Column:
    """The value of a few hexadecimal digits."""
    return F.conv(digits, 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, source_size). One row a source passes through one
    task here: sources are a dimension, not data."""
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(table, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ordered = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    after = ordered.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    # The first source that is not capped sets the level of all that follow; later levels only fall.
    final = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    target = F.when(F.col("capped") | final.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * final))
    return leveled.select(
        "source", "source_size", target.alias("target"),
    ).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def plan_copies(docs: DataFrame, source_col: str = "source", text_col: str = "text", *, weights=WEIGHTS,
                share: float = SHARE, most: float = MOST, seed: int = 7, buckets: int | None = None, keep=None) -> DataFrame:
    """``docs`` (columns ``keep``, all by default) with size, source_size, target, copies and taken."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in MADE]
    planned = _planned(docs, keep, source_col, text_col, weights, share, most, seed, buckets)
    return planned.select(*_named(keep), *MADE)


def _named(keep: list[str]) -> list[Column]:
    """The kept columns under their own names."""
    return [F.col(f"_kept_{i}").alias(c) for i, c in enumerate(keep)]


def _planned(docs: DataFrame, keep: list[str], source_col: str, text_col: str, weights, share: float, most: float, seed: int, buckets: int | None) -> DataFrame:
    """The kept columns by number, so that their names meet no others, with size, source_size, target, copies and taken."""
    shared_dir(docs.sparkSession)
    size_class = F.when(F.col("size") <= 0, F.lit(0)).otherwise(F.floor(F.log2("size") * 4) + 1).cast("int")
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"_kept_{i}") for i, c in enumerate(keep)],
        # Never null, in the order of the sources with null last: plain keys keep one partitioning for join and window.
        F.coalesce(F.concat(F.lit("a"), F.col(f"`{source_col}`").cast("string")), F.lit("b")).alias("_source"),
        word_count(f"`{text_col}`").alias("size"),
        _digest(F.lit(seed), *[F.col(f"`{c}`") for c in sorted(docs.columns)]).alias("_h"),
    )
    rows = written(rows.select("*", size_class.alias("_class")), "sizes")
    buckets = buckets or max(BUCKETS, rows.count() // ROWS_A_BUCKET)
    rows = rows.withColumn("_bucket", (_number(F.substring("_h", 1, 8)) % buckets).cast("int"))
    groups = written(rows.groupBy("_source", "_class", "_bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words")), "groups")
    classes = groups.groupBy("_source", "_class").agg(F.sum("rows").alias("rows"), F.sum("words").alias("words"))
    targets = source_targets(classes.groupBy(F.col("_source").alias("source")).agg(F.sum("words").alias("source_size")), weights, share, most)
    # Classes of a source (at most 4 x 64), then buckets of a class: small windows of counts.
    running = Window.partitionBy("_source").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("_class_before", F.coalesce(F.sum("rows").over(running), F.lit(0)))
    inner = Window.partitionBy("_source", "_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.withColumn("_bucket_before", F.coalesce(F.sum("rows").over(inner), F.lit(0)))
    rated = classes.join(targets, classes["_source"] == targets["source"]).select(
        F.col("_source").alias("_s"), F.col("_class").alias("_c"), "_class_before", "source_size", "target", "rate")
    starts = starts.join(rated, (starts["_source"] == rated["_s"]) & (starts["_class"] == rated["_c"])).select(
        F.col("_source").alias("_s"), F.col("_class").alias("_c"), F.col("_bucket").alias("_b"),
        (F.col("_class_before") + F.col("_bucket_before")).alias("_before"), "source_size", "target", "rate")
    on = (rows["_source"] == starts["_s"]) & (rows["_class"] == starts["_c"]) & (rows["_bucket"] == starts["_b"])
    in_bucket = Window.partitionBy("_source", "_class", "_bucket").orderBy("_h")
    # An offset on a grid, so that whole rates cross whole numbers of integers.
    offset = (_number(F.substring(_digest(F.lit(seed), F.lit("offset"), F.col("_source")), 1, 3)) + F.lit(0.5)) / 4096
    at = F.col("_before") + F.row_number().over(in_bucket)
    crossed = F.floor(at * F.col("rate") + offset) - F.floor((at - 1) * F.col("rate") + offset)
    copies = F.greatest(F.lit(0), F.least(crossed, F.ceil(F.lit(float(most))))).cast("long")
    return (
        rows.join(starts, on).withColumn("copies", copies)
        .select(*[f"_kept_{i}" for i in range(len(keep))], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", *, weights=WEIGHTS, share: float = SHARE, most: float = MOST,
        seed: int = 7, buckets: int | None = None) -> DataFrame:
    """The mix: each row of ``docs``, with all its columns as they are, as often as it has copies."""
    planned = _planned(docs, docs.columns, source_col, text_col, weights, share, most, seed, buckets)
    repeated = planned.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*_named(docs.columns))
