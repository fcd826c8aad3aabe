"""Integrity checks of a benchmark as rows (check, passed, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.remote import manifest  # noqa: F401


def _checks(df: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Name to (passed, detail) over ``df``, which has one row: it is read once, however many checks there are."""
    rows = [F.struct(F.lit(name).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"), detail.cast("string").alias("detail")) for name, (passed, detail) in checks.items()]
    return df.select(F.inline(F.array(*rows)))


def filled(column: str) -> Column:
    return F.length(F.coalesce(F.col(column), F.lit(""))) > 0


def benchmark_checks(name: str, rows: DataFrame, ids: int, variants: int) -> list[DataFrame]:
    """Row count, unique keys, one label an id, filled texts, and balance within each variant."""
    keys = rows.groupBy("variant", "id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.when(F.col("n") > 1, 1)).alias("bad"))
    labels = rows.groupBy("id").agg(F.count_distinct("label").alias("n")).agg(F.count(F.when(F.col("n") != 1, 1)).alias("bad"))
    texts = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~filled("text"), 1)).alias("empty"), F.count(F.when(~filled("normalized_text"), 1)).alias("blank"))
    balance = rows.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("label") == 1, 1)).alias("hate")).agg(
        F.count(F.lit(1)).alias("seen"), F.count(F.when((F.col("n") != ids) | (F.col("hate") != ids // 2), 1)).alias("bad"))
    return [
        _checks(texts, {
            f"{name}_row_count": (F.col("n") == ids * variants, F.col("n")),
            f"{name}_text_filled": (F.col("empty") == 0, F.col("empty")),
            f"{name}_normalized_filled": (F.col("blank") == 0, F.col("blank"))}),
        _checks(keys, {f"{name}_unique_keys": (F.col("bad") == 0, F.col("bad"))}),
        _checks(labels, {f"{name}_one_label": (F.col("bad") == 0, F.col("bad"))}),
        _checks(balance, {f"{name}_balanced": ((F.col("bad") == 0) & (F.col("seen") == variants), F.col("bad"))}),
    ]


def token_checks(name: str, rows: DataFrame, most: int = 256) -> list[DataFrame]:
    found = rows.agg(F.min("token_count").alias("low"), F.max("token_count").alias("high"), F.min("supervised_token_count").alias("supervised"))
    return [_checks(found, {
        f"{name}_token_bounds": ((F.col("low") > 0) & (F.col("high") <= most), F.concat_ws("..", "low", "high")),
        f"{name}_supervised_tokens": (F.col("supervised") > 0, F.col("supervised"))})]


def overlap_checks(overlaps: DataFrame) -> DataFrame:
    return overlaps.select(
        F.concat_ws("_", F.lit("overlap"), "left_part", "right_part").alias("check"), (F.col("shared") == 0).alias("passed"), F.col("shared").cast("string").alias("detail"))


def label_checks(rows: DataFrame, clean: str = "clean") -> DataFrame:
    """For each other variant: every row has a clean twin by id, with the same label."""
    base = rows.filter(F.col("variant") == clean).select("id", F.col("label").alias("clean_label"))
    joined = rows.filter(F.col("variant") != clean).join(base, "id", "left")
    bad = F.count(F.when(~F.col("label").eqNullSafe(F.col("clean_label")), 1))
    found = joined.groupBy("variant").agg(bad.alias("bad"))
    return found.select(F.concat(F.lit("labels_"), "variant").alias("check"), (F.col("bad") == 0).alias("passed"), F.col("bad").cast("string").alias("detail"))


def prediction_checks(predictions: DataFrame, scopes: DataFrame) -> DataFrame:
    """For each system: its keys are one of the known scopes, and unique."""
    twice = predictions.groupBy("system", "variant", "id").agg(F.count(F.lit(1)).alias("n")).groupBy("system").agg(F.count(F.when(F.col("n") > 1, 1)).alias("bad"))
    joined = scopes.join(twice, "system")
    return joined.select(
        F.concat_ws("_", F.lit("predictions"), "system").alias("check"), ((F.col("scope") != "unknown") & (F.col("bad") == 0)).alias("passed"), F.col("scope").alias("detail"))


def report(checks: list[DataFrame]) -> DataFrame:
    """All checks, and a last row that passes when every one does. The checks, some dozens of rows, are gathered into
    one, so that none is made twice."""
    every = reduce(lambda a, b: a.unionByName(b), checks).agg(F.collect_list(F.struct("check", "passed", "detail")).alias("checks"))
    failed = F.size(F.filter("checks", lambda c: ~c["passed"]))
    verdict = F.struct(F.lit("verdict").alias("check"), (failed == 0).alias("passed"), failed.cast("string").alias("detail"))
    return every.select(F.inline(F.concat("checks", F.array(verdict))))


def completion(expected: DataFrame, results: DataFrame) -> DataFrame:
    """By provider: expected, valid, missing, duplicate, unexpected and invalid rows. ``expected`` has (id, variant),
    ``results`` (provider, id, variant, pred_label)."""
    providers = results.select("provider").distinct()
    per_key = results.groupBy("provider", "id", "variant").agg(F.count(F.lit(1)).alias("n"), F.count("pred_label").alias("read"))
    want = expected.select("id", "variant").distinct().crossJoin(F.broadcast(providers)).withColumn("wanted", F.lit(1))  # a few providers
    joined = want.join(per_key, ["provider", "id", "variant"], "full")
    n = lambda c: F.count(F.when(c, 1))
    out = joined.groupBy("provider").agg(
        n(F.col("wanted").isNotNull()).alias("expected_rows"), n(F.col("wanted").isNotNull() & (F.col("read") > 0)).alias("valid_rows"),
        n(F.col("n").isNull()).alias("missing_rows"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("duplicate_rows"),
        n(F.col("wanted").isNull()).alias("unexpected_rows"), F.coalesce(F.sum(F.col("n") - F.col("read")), F.lit(0)).alias("invalid_label_rows"))
    bad = F.col("missing_rows") + F.col("duplicate_rows") + F.col("unexpected_rows") + F.col("invalid_label_rows")
    return out.withColumn("status", F.when(bad == 0, "complete").otherwise("incomplete"))
