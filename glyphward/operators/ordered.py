"""Running totals over a whole order without one task that sees it all: rows are dealt into bins that follow the order,
bins are summed up first, and each row adds what earlier bins hold.

Bins follow the data: one value in ``SPACING`` is a cut point, picked by its hash, so ten times the values make ten times
the bins and no bin outgrows a task, however values are spread. Cut points are part of the query, as one row; nothing
runs while a query is built. They are 8 MB for each 10 ** 11 distinct values, and a table of fewer than ``SPACING`` values has
one bin or a few. Equal values are in one bin, so rows should be counted by value first where values repeat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values for each cut point, on average.
SPACING = 1 << 17


def binned(df: DataFrame, first: str) -> DataFrame:
    """``df`` with ``_bin``, which grows with the column ``first``; nulls are in the first bin."""
    picked = F.pmod(F.xxhash64(F.lit("cut"), first), F.lit(SPACING)) == 0
    cuts = df.filter(picked).agg(F.array_sort(F.collect_set(first)).alias("_cuts"))  # one row
    return df.crossJoin(F.broadcast(cuts)).withColumn("_bin", last_not_above(F.col("_cuts"), F.col(first))).drop("_cuts")


def last_not_above(points: Column, value: Column) -> Column:
    """How many of the sorted points are at most the value, by halving; as many steps as the points need."""
    state = F.struct(F.lit(0).alias("low"), F.size(points).alias("high"))

    def halve(s, _):
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        fits = F.get(points, middle) <= value
        go = s["low"] < s["high"]
        return F.struct(
            F.when(go & fits, middle + 1).otherwise(s["low"]).alias("low"), F.when(go & ~fits, middle).otherwise(s["high"]).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(points) + F.lit(1))).cast("int"))
    return F.aggregate(steps, state, halve)["low"]


def sums_before(df: DataFrame, order: Sequence[str], sums: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with, for each name in ``sums``, the sum over all rows of the same keys that come earlier. ``order`` names
    columns and is total for a key. What a bin adds comes as a row of its own, first in the bin: nothing is joined."""
    values = {name: f"_value_{name}" for name in sums}
    rows = binned(df, order[0]).withColumns({values[name]: value for name, value in sums.items()})
    across = Window.partitionBy(*keys, *([] if keys else [F.lit(0)])).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_bin").agg(*[F.sum(v).alias(v) for v in values.values()])  # a row a key and bin
    carried = totals.select(*keys, "_bin", *[F.sum(v).over(across).alias(v) for v in values.values()], F.lit(0).alias("_row"))
    inside = Window.partitionBy(*keys, "_bin").orderBy("_row", *order).rowsBetween(Window.unboundedPreceding, -1)
    every = rows.withColumn("_row", F.lit(1)).unionByName(carried, allowMissingColumns=True)
    summed = every.withColumns({name: F.coalesce(F.sum(v).over(inside), F.lit(0)) for name, v in values.items()})
    return summed.filter("_row = 1").drop("_row", "_bin", *values.values())
