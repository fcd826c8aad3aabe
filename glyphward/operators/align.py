"""Alignment by key: rows of the same item across variants, checked joins, what is left to do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import sums_before


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    return df


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _reject(found: DataFrame, message: str) -> None:
    if n := found.count():
        raise ValueError(f"{message}: {n}")


def aligned(rows: DataFrame, ids: DataFrame, variants: DataFrame, *, strict: bool = True) -> DataFrame:
    """Rows of the listed ids for every variant, with their place in the list. ``ids`` has (id, sample_order). A
    strict call fails where an id has no row in some variant."""
    wanted = ids.crossJoin(F.broadcast(variants.select("variant", "variant_rank")))
    if strict:
        _reject(wanted.join(rows, ["id", "variant"], "left_anti"), "ids without a row")
    return wanted.join(rows, ["id", "variant"]).drop("variant_rank")


def checked_left_join(left: DataFrame, right: DataFrame, on: list[str], *, suffix: str = "_right", complete: str | None = None) -> DataFrame:
    """A left join that must be one to one; shared columns of the right side get a suffix. ``complete`` names a right
    column that must never be null afterwards."""
    _reject(duplicates(left, *on), "keys more than once on the left")
    _reject(duplicates(right, *on), "keys more than once on the right")
    shared = {c: f"{c}{suffix}" for c in right.columns if c in left.columns and c not in on}
    joined = left.join(right.withColumnsRenamed(shared), on, "left")
    if complete:
        _reject(joined.filter(F.col(shared.get(complete, complete)).isNull()), "rows without a partner")
    return joined


def pending(todo: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """What a resumed run still has to do."""
    return todo.join(done, list(keys), "left_anti")


def resumed(todo: DataFrame, done: DataFrame, work, *keys: str) -> DataFrame:
    """Done rows, and ``work`` applied to the others."""
    return done.unionByName(work(pending(todo, done, *keys)), allowMissingColumns=True)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def in_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows whose value is listed, with its place; values of the list that are absent do no harm."""
    listed = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(order)], f"`{column}` string, place int")
    return df.join(F.broadcast(listed), column)


def in_variant_order(rows: DataFrame, variants: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with ``place`` in the order of variants, then of keys, which is how results are handed on; the place is a
    running sum by ranges, so no task numbers all rows."""
    ranked = rows.join(F.broadcast(variants.select("variant", "variant_rank")), "variant").withColumn("_order", F.struct("variant_rank", F.col(key)))  # a few variants
    return sums_before(ranked, ["_order"], {"place": F.lit(1)}).drop("_order", "variant_rank")


def keep_last(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the last in the given order."""
    return first_of(df, keys, *[o.desc() for o in order])


def first_of(df: DataFrame, keys: list[str], *order: Column, most: int = 1) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")


def scope(predictions: DataFrame, scopes: dict[str, DataFrame]) -> DataFrame:
    """(system, scope): the first scope whose set of (variant, id) equals the system's, else unknown. Sets are compared
    by their sizes and the size of the overlap, all scopes in one join."""
    names = list(scopes)
    inside = lambda i: F.count(F.when(F.col(f"in{i}"), 1))
    tagged = reduce(lambda a, b: a.unionByName(b), [keys.select("variant", "id", F.lit(i).alias("of")) for i, keys in enumerate(scopes.values())])
    keys = tagged.groupBy("variant", "id").agg(*[F.bool_or(F.col("of") == i).alias(f"in{i}") for i in range(len(names))])
    wholes = keys.agg(*[inside(i).alias(f"whole{i}") for i in range(len(names))])
    mine = predictions.select("variant", "id", "system").distinct().join(keys, ["variant", "id"], "left")
    sizes = mine.groupBy("system").agg(F.count(F.lit(1)).alias("size"), *[inside(i).alias(f"overlap{i}") for i in range(len(names))])
    equal = [F.when((F.col("size") == F.col(f"whole{i}")) & (F.col(f"overlap{i}") == F.col(f"whole{i}")), name) for i, name in enumerate(names)]
    return sizes.crossJoin(F.broadcast(wholes)).select("system", F.coalesce(*equal, F.lit("unknown")).alias("scope"))  # one row
