"""Confusion counts, the metrics made from them, and robustness against a clean variant. Predictions are rows with
label (0/1) and pred_label (0/1, null where an answer could not be read). Rates come from whole counts, so they do
not depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import sums_before

METRICS = (
    "rows", "valid_predictions", "parse_failures", "parse_failure_rate", "accuracy", "balanced_accuracy", "macro_f1", "hate_precision",
    "hate_recall", "fnr", "fpr", "predicted_hate_rate", "balanced_error", "max_failure_rate", "tn", "fp", "fn", "tp",
)


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def counts(label: str = "label", pred: str = "pred_label") -> list[Column]:
    truth, said = F.col(label) == 1, F.col(pred) == 1
    return [
        F.count(F.lit(1)).alias("rows"), F.count(pred).alias("valid_predictions"), _n(F.col(pred).isNull()).alias("parse_failures"),
        _n(~truth & ~said).alias("tn"), _n(~truth & said).alias("fp"), _n(truth & ~said).alias("fn"), _n(truth & said).alias("tp"),
    ]


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def from_counts(df: DataFrame) -> DataFrame:
    """Adds the derived metrics to rows, valid_predictions, parse_failures, tn, fp, fn and tp. Without a valid
    prediction the failure rate is 1 and the metrics are null. Balanced accuracy averages the classes among the
    labels, macro F1 those among labels or predictions."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    valid = F.col("valid_predictions")
    some = lambda x: F.when(valid > 0, x)
    has1, has0 = (tp + fn > 0).cast("int"), (tn + fp > 0).cast("int")
    in1, in0 = (tp + fn + fp > 0).cast("int"), (tn + fp + fn > 0).cast("int")
    fnr, fpr = fn / F.greatest(F.lit(1), fn + tp), fp / F.greatest(F.lit(1), fp + tn)
    return df.withColumns({
        "parse_failure_rate": F.when(valid > 0, F.col("parse_failures") / F.greatest(F.lit(1), F.col("rows"))).otherwise(F.lit(1.0)),
        "accuracy": some((tp + tn) / valid),
        "balanced_accuracy": some((_share(tp, tp + fn) + _share(tn, tn + fp)) / (has1 + has0)),
        "macro_f1": some((_share(2 * tp, 2 * tp + fp + fn) + _share(2 * tn, 2 * tn + fp + fn)) / (in1 + in0)),
        "hate_precision": some(_share(tp, tp + fp)),
        "hate_recall": some(_share(tp, tp + fn)),
        "fnr": some(fnr), "fpr": some(fpr),
        "predicted_hate_rate": some((tp + fp) / valid),
        "balanced_error": some((fnr + fpr) / 2),
        "max_failure_rate": some(F.greatest(fnr, fpr)),
    })


def metrics(predictions: DataFrame, *keys: str) -> DataFrame:
    """One row of metrics for each group; with no keys, for all rows."""
    return from_counts(predictions.groupBy(*keys).agg(*counts())).select(*keys, *METRICS)


def metrics_and_overall(predictions: DataFrame) -> DataFrame:
    """By (system, variant) and by system at once; ``variant`` is null in the latter."""
    sets = predictions.groupingSets([("system", "variant"), ("system",)], "system", "variant").agg(*counts())
    return from_counts(sets).select("system", "variant", *METRICS)


def by_variant(predictions: DataFrame, variants: DataFrame, split: str | None = None) -> DataFrame:
    """Metrics of each system over all variants, those without rows too, and the drop of balanced accuracy from the
    first variant."""
    if split is not None:
        predictions = predictions.filter(F.col("split") == split)
    counted = predictions.groupBy("system", "variant").agg(*counts())
    dense = counted.select("system").distinct().crossJoin(F.broadcast(variants.select("variant", "variant_rank", "variant_label")))
    numbers = [c for c in counted.columns if c not in ("system", "variant")]
    full = dense.join(counted, ["system", "variant"], "left").na.fill(0, numbers)
    ranked = Window.partitionBy("system").orderBy("variant_rank")
    drop = F.first("balanced_accuracy").over(ranked) - F.col("balanced_accuracy")
    return from_counts(full).withColumn("balanced_accuracy_drop_from_clean", drop).select(
        "system", "variant", "variant_label", "variant_rank", *METRICS, "balanced_accuracy_drop_from_clean")


def system_ranking(variant_metrics: DataFrame) -> DataFrame:
    """Systems from the best worst case down; ties go by name."""
    summary = variant_metrics.groupBy("system").agg(
        F.min("balanced_accuracy").alias("worst_case_balanced_accuracy"), F.avg("balanced_accuracy").alias("mean_balanced_accuracy"),
        F.avg("macro_f1").alias("mean_macro_f1"), F.max("max_failure_rate").alias("worst_max_failure_rate"), F.avg("fnr").alias("mean_fnr"),
        F.avg("fpr").alias("mean_fpr"), F.avg("predicted_hate_rate").alias("mean_predicted_hate_rate"), F.sum("parse_failures").alias("total_parse_failures"))
    # One row a system: the only window here over everything.
    order = Window.orderBy(
        F.col("worst_case_balanced_accuracy").desc_nulls_last(), F.col("worst_max_failure_rate").asc_nulls_last(),
        F.col("mean_balanced_accuracy").desc_nulls_last(), "system")
    return summary.withColumn("rank", F.row_number().over(order))


def robustness(scored: DataFrame, clean: str = "clean", threshold: float = 0.5) -> DataFrame:
    """Per (system, variant) from rows (system, variant, id, label, probability): accuracy, precision, recall and F1
    at a threshold, their drops from the clean variant, attack success among rows the clean variant got right, mean
    shift of the probability and its mean drop on true hate. Rows meet their clean twin by id and label."""
    said = scored.withColumn("said", (F.col("probability") >= threshold).cast("int"))
    base = said.filter(F.col("variant") == clean).select("system", "id", "label", F.col("probability").alias("clean_probability"), F.col("said").alias("clean_said"))
    paired = said.join(base, ["system", "id", "label"])
    hate, right = F.col("label") == 1, F.col("clean_said") == F.col("label")
    shift = F.col("clean_probability") - F.col("probability")
    counted = paired.groupBy("system", "variant").agg(
        F.count(F.lit(1)).alias("rows"), _n(hate & (F.col("said") == 1)).alias("tp"), _n(~hate & (F.col("said") == 1)).alias("fp"),
        _n(hate & (F.col("said") == 0)).alias("fn"), _n(~hate & (F.col("said") == 0)).alias("tn"),
        _n(right).alias("clean_right"), _n(right & (F.col("said") != F.col("label"))).alias("attacked"),
        F.avg(F.abs(shift)).alias("confidence_shift"), F.coalesce(F.avg(F.when(hate, shift)), F.lit(0.0)).alias("hate_confidence_drop"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rated = counted.withColumns({
        "accuracy": (tp + tn) / F.col("rows"), "precision": _share(tp, tp + fp), "recall": _share(tp, tp + fn), "f1": _share(2 * tp, 2 * tp + fp + fn),
        "attack_success_rate": _share(F.col("attacked"), F.col("clean_right"))})
    first = Window.partitionBy("system").orderBy((F.col("variant") != clean).cast("int"), "variant")
    return rated.withColumns({"f1_drop_from_clean": F.first("f1").over(first) - F.col("f1"), "recall_drop_from_clean": F.first("recall").over(first) - F.col("recall")}).select(
        "system", "variant", "rows", "accuracy", "precision", "recall", "f1", "f1_drop_from_clean", "recall_drop_from_clean", "attack_success_rate", "confidence_shift", "hate_confidence_drop")


def auroc(scored: DataFrame, *keys: str, score: str = "probability", label: str = "label") -> DataFrame:
    """Area under the ROC curve of each group, ties counted half; null with a single class. Scores are counted first, and
    the counts below each are summed up by ranges of scores, so no task holds a whole group."""
    per_score = scored.groupBy(*keys, score).agg(_n(F.col(label) == 1).alias("p"), _n(F.col(label) == 0).alias("n"))
    placed = sums_before(per_score, [score], {"below": F.col("n")}, keys)
    wins = F.col("p") * (2 * F.col("below") + F.col("n"))  # twice the pairs won
    return placed.withColumn("wins", wins).groupBy(*keys).agg(
        F.sum("wins").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n")).select(
        *keys, F.col("p").alias("positives"), F.col("n").alias("negatives"), F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (2 * F.col("p") * F.col("n"))).alias("auroc"))


def failures(scored: DataFrame, clean: str = "clean", threshold: float = 0.5, most: int = 50) -> DataFrame:
    """The first ``most`` rows by id of each (system, variant) that the clean variant got right and the variant wrong; no texts."""
    said = scored.withColumn("prediction", (F.col("probability") >= threshold).cast("int"))
    base = said.filter(F.col("variant") == clean).select("system", "id", F.col("probability").alias("clean_probability"), F.col("prediction").alias("clean_prediction"))
    lost = said.filter(F.col("variant") != clean).join(base, ["system", "id"]).filter("clean_prediction = label AND prediction <> label")
    place = F.row_number().over(Window.partitionBy("system", "variant").orderBy("id"))
    return lost.withColumn("place", place).filter(F.col("place") <= most).select(
        "system", "variant", "id", "label", "clean_probability", F.col("probability").alias("variant_probability"), "clean_prediction",
        F.col("prediction").alias("variant_prediction"), (F.col("probability") - F.col("clean_probability")).alias("probability_delta"))
