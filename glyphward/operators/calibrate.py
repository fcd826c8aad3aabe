"""Thresholds: candidates, sweeps and choices.

A sweep needs no join of thresholds with rows. Rows are counted by score once; thresholds take their place in the order
of the scores, and what is below each is a running sum over that order, by bins that follow the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import METRICS, auroc, from_counts, robustness
from .ordered import sums_before

QUANTILES = 401
MARGIN = 1e-6


def candidates(scored: DataFrame, score: str = "score", quantiles: int = QUANTILES, accuracy: int | None = None) -> DataFrame:
    """Distinct quantiles, and a step beyond the least and greatest score. Exact quantiles are interpolated; with an
    ``accuracy`` they are observed scores whose rank is off by at most rows / accuracy, from summaries of bounded size."""
    ends = scored.agg(F.min(score).alias("low"), F.max(score).alias("high")).filter("low IS NOT NULL")
    ends = ends.select(F.explode(F.array(F.col("low") - MARGIN, F.col("high") + MARGIN)).alias("threshold"))
    if accuracy is None:
        return ends.unionByName(exact_quantiles(scored, score, quantiles).select("threshold")).distinct()
    points = [i / (quantiles - 1) for i in range(quantiles)]
    found = scored.agg(F.percentile_approx(score, points, accuracy).alias("q"))
    return ends.unionByName(found.select(F.explode("q").alias("threshold"))).distinct()


def exact_quantiles(scored: DataFrame, score: str, quantiles: int) -> DataFrame:
    """(k, threshold): the k-th of evenly spaced quantiles, interpolated between the two scores it falls between. Ranks
    are running sums of the counts by score, so no task holds all scores."""
    parts = quantiles - 1
    counted = scored.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(F.count(F.lit(1)).alias("n"))
    placed = sums_before(counted, ["score"], {"before": F.col("n")})
    ranked = placed.crossJoin(F.broadcast(scored.agg((F.count(score) - 1).alias("last"))))  # one row
    at = lambda k: F.col("last") * (k / F.lit(float(parts)))
    per_row = F.lit(float(parts)) / F.greatest(F.col("last"), F.lit(1))
    least = F.greatest(F.lit(0), F.floor((F.col("before") - 1) * per_row) - 1).cast("int")
    most = F.least(F.lit(parts), F.ceil((F.col("before") + F.col("n")) * per_row) + 1).cast("int")
    near = F.when(least <= most, F.sequence(least, most)).otherwise(F.array().cast("array<int>"))
    holds = lambda rank: (rank >= F.col("before")) & (rank < F.col("before") + F.col("n"))
    found = ranked.withColumn("near", F.filter(near, lambda k: holds(F.floor(at(k))) | holds(F.ceil(at(k))))).filter(F.size("near") > 0)
    found = found.select("score", "before", "n", "last", F.explode("near").alias("k"))
    side = lambda rank: F.max(F.when(holds(rank(at(F.col("k")))), F.col("score")))
    sides = found.groupBy("k", "last").agg(side(F.floor).alias("low"), side(F.ceil).alias("high"))
    share = at(F.col("k")) - F.floor(at(F.col("k")))
    return sides.select("k", (F.col("low") + (F.col("high") - F.col("low")) * share).alias("threshold"))


def sweep(scored: DataFrame, score: str = "score", label: str = "label", thresholds: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """All metrics at each threshold, where score >= threshold is a hit; for each group of ``keys``, if there are any.
    Thresholds may be as many as the scores, and of a group of their own where they have the keys as columns: they are
    rows that take their place in the order of the counted scores, and running sums tell what is below each."""
    thresholds = candidates(scored, score) if thresholds is None else thresholds
    per_score = scored.filter(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("threshold")).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("p"), F.count(F.when(F.col(label) == 0, 1)).alias("n"))
    own = [k for k in keys if k in thresholds.columns]
    points = thresholds.select(*own, "threshold").filter("threshold IS NOT NULL").distinct()
    totals = per_score.groupBy(*keys).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))  # a row a group
    if len(own) < len(keys):
        points = points.join(totals.select(*keys), own) if own else points.crossJoin(F.broadcast(totals.select(*keys)))
    # A threshold comes before the scores that equal it.
    rows = per_score.withColumn("kind", F.lit(1)).unionByName(points.withColumns({"p": F.lit(0), "n": F.lit(0), "kind": F.lit(0)}))
    placed = sums_before(rows, ["threshold", "kind"], {"below_p": F.col("p"), "below_n": F.col("n")}, keys).filter("kind = 0")
    same = {k: f"_of_{k}" for k in keys}
    on = [F.col(k).eqNullSafe(F.col(other)) for k, other in same.items()]
    joined = placed.join(totals.withColumnsRenamed(same), on, "left") if keys else placed.crossJoin(F.broadcast(totals))
    joined = joined.na.fill(0, ["all_p", "all_n"])
    total = F.col("all_p") + F.col("all_n")
    counted = joined.select(
        *keys, "threshold", total.alias("rows"), total.alias("valid_predictions"), F.lit(0).cast("long").alias("parse_failures"),
        F.col("below_n").alias("tn"), (F.col("all_n") - F.col("below_n")).alias("fp"), F.col("below_p").alias("fn"), (F.col("all_p") - F.col("below_p")).alias("tp"))
    return from_counts(counted).select(*keys, "threshold", *METRICS)


def best_threshold(swept: DataFrame) -> DataFrame:
    """The winner: least balanced error, then greatest macro F1, least failure, lowest threshold."""
    return swept.orderBy("balanced_error", F.desc("macro_f1"), "max_failure_rate", "threshold").limit(1)


def apply_threshold(scored: DataFrame, threshold: float, system: str, score: str = "score") -> DataFrame:
    hit = (F.col(score) >= threshold).cast("int")
    return scored.withColumns({"system": F.lit(system), "threshold": F.lit(threshold), "pred_label": hit, "raw_output": F.when(hit == 1, "hate").otherwise("non-hate")})


def router_sweep(routed: DataFrame, thresholds: list[float]) -> DataFrame:
    """For each threshold on the obfuscation score: rows at or above it take the robust probability, others the
    clean one. Utility is F1 less a hundredth of the share routed. Rows are (label, clean, robust, obfuscation); they
    are counted in the intervals between thresholds once, then summed from either side."""
    points = sorted(set(thresholds))
    place = sum(((F.col("obfuscation") >= t).cast("int") for t in points), F.lit(0))
    side = lambda c, truth: F.count(F.when((F.col(c) >= 0.5) & (F.col("label") == truth), 1))
    binned = routed.withColumn("place", place).groupBy("place").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("label") == 1, 1)).alias("pos"),
        side("robust", 1).alias("rtp"), side("robust", 0).alias("rfp"), side("clean", 1).alias("ctp"), side("clean", 0).alias("cfp"))
    numbered = routed.sparkSession.createDataFrame([(0, None), *[(i + 1, t) for i, t in enumerate(points)]], "place int, threshold double")
    joined = numbered.join(binned, "place", "left").na.fill(0, ["n", "pos", "rtp", "rfp", "ctp", "cfp"])
    up = Window.partitionBy(F.lit(0)).orderBy(F.desc("place"))
    down = Window.partitionBy(F.lit(0)).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    tp = F.sum("rtp").over(up) + F.sum("ctp").over(down)
    fp = F.sum("rfp").over(up) + F.sum("cfp").over(down)
    rows = joined.select("threshold", F.sum("n").over(up).alias("routed"), F.sum("n").over(every).alias("rows"), F.sum("pos").over(every).alias("pos"), tp.alias("tp"), fp.alias("fp"))
    f1 = F.coalesce(2 * F.col("tp") / F.nullif(F.col("tp") + F.col("fp") + F.col("pos"), F.lit(0)), F.lit(0.0))
    rate = F.col("routed") / F.col("rows")
    return rows.filter("threshold IS NOT NULL AND rows > 0").select(
        "threshold", (f1 - 0.01 * rate).alias("utility"), rate.alias("route_robust_rate"), (1 - rate).alias("clean_route_rate"),
        ((F.col("tp") + (F.col("rows") - F.col("pos") - F.col("fp"))) / F.col("rows")).alias("accuracy"),
        F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.lit(0.0)).alias("precision"),
        F.coalesce(F.col("tp") / F.nullif(F.col("pos"), F.lit(0)), F.lit(0.0)).alias("recall"), f1.alias("f1"))


def linspace(low: float, high: float, n: int) -> list[float]:
    """``n`` points from ``low`` to ``high``, both included."""
    return [low + i * (high - low) / (n - 1) for i in range(n)] if n > 1 else [low]


def route(rows: DataFrame, threshold: float) -> DataFrame:
    """Adds ``routed`` and the ``probability`` of the model that each row is sent to."""
    routed = F.col("obfuscation") >= threshold
    return rows.withColumns({"routed": routed, "probability": F.when(routed, F.col("robust")).otherwise(F.col("clean"))})


def router_report(rows: DataFrame, threshold: float) -> DataFrame:
    """A router at work, by variant: robustness against the clean variant, area under the curve, share of rows routed,
    mean obfuscation score. Rows are (variant, id, label, clean, robust, obfuscation)."""
    sent = route(rows, threshold).withColumn("system", F.lit("router"))
    shares = sent.groupBy("variant").agg(F.avg(F.col("routed").cast("int")).alias("route_robust_rate"), F.avg("obfuscation").alias("mean_obfuscation_score"))
    joined = robustness(sent).drop("system").join(auroc(sent, "variant").select("variant", "auroc"), "variant").join(shares, "variant")
    return joined.withColumn("threshold", F.lit(threshold))


def best_route(swept: DataFrame) -> DataFrame:
    return swept.orderBy(F.desc("utility"), F.desc("f1"), "threshold").limit(1)


def best_checkpoint(runs: DataFrame) -> DataFrame:
    """Runs from the best: balanced accuracy, then least failure, then macro F1, then the earlier step."""
    return runs.orderBy(F.desc("balanced_accuracy"), "max_failure_rate", F.desc("macro_f1"), "step")
