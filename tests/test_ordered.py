"""Running sums by bins, and what is built on them, against plain loops."""

import bisect
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphward.operators import calibrate, metrics, ordered, sampling


@pytest.mark.parametrize("spacing", [3, 1 << 17])
@pytest.mark.parametrize("keys", [(), ("g",), ("g", "h")])
def test_sums_before(spark, monkeypatch, spacing, keys):
    monkeypatch.setattr(ordered, "SPACING", spacing)
    rnd = random.Random(spacing)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(2), None if k == 7 else round(rnd.random(), 2), k, rnd.randrange(9)) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, h int, v double, id int, n long").repartition(3)
    found = {r.id: (r.before, r.rows) for r in ordered.sums_before(df, ["v", "id"], {"before": F.col("n"), "rows": F.lit(1)}, keys).collect()}
    assert len(found) == 400
    held = defaultdict(lambda: [0, 0])
    for g, h, v, k, n in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[3])):
        at = held[(g, h)[:len(keys)]]
        assert found[k] == tuple(at)
        at[0] += n
        at[1] += 1


def test_bins_follow_the_rows(spark, monkeypatch):
    """Ten times the rows: ten times the bins, none larger; values lie close together but for a few."""
    monkeypatch.setattr(ordered, "SPACING", 256)
    for n in (20_000, 200_000):
        df = spark.range(n).select(F.when(F.col("id") % 1000 == 0, F.col("id") * 1e6).otherwise(1 + F.col("id") / n * 1e-6).alias("v"))
        sizes = [r["count"] for r in ordered.binned(df, "v").groupBy("_bin").count().collect()]
        assert max(sizes) < 256 * 15 and 0.5 < len(sizes) / (n / 256) < 1.5


def test_nothing_runs_while_a_query_is_built(spark):
    scored = spark.range(500).select((F.col("id") % 37 / 37).alias("score"), (F.col("id") % 2).cast("int").alias("label"), F.col("id"))
    context = spark.sparkContext
    context.setJobGroup("build", "")
    calibrate.sweep(scored)
    metrics.auroc(scored, score="score")
    sampling.shuffled(scored, 1)
    assert list(context.statusTracker().getJobIdsForGroup("build")) == []
    context.setJobGroup("run", "")
    assert metrics.auroc(scored, score="score").count() == 1 and len(context.statusTracker().getJobIdsForGroup("run"))
    context._jsc.clearJobGroup()


@pytest.mark.parametrize("own", [True, False])
def test_sweep_of_a_threshold_table_by_group(spark, monkeypatch, own):
    """Thousands of thresholds and scores by group; neither side is gathered in one value."""
    monkeypatch.setattr(ordered, "SPACING", 200)
    rnd = random.Random(9)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([rnd.random(), round(rnd.random(), 1)]), rnd.randrange(2)) for _ in range(6000)]
    points = [(rnd.choice(["a", "b", None, "z"]), rnd.choice([rnd.random(), round(rnd.random(), 1)])) for _ in range(5000)] + [("a", None)]
    scored = spark.createDataFrame(rows + [("a", None, 1)], "system string, score double, label int").repartition(4)
    table = spark.createDataFrame(points, "system string, threshold double")
    found = calibrate.sweep(scored, thresholds=table if own else table.select("threshold"), keys=("system",)).collect()
    side = {(g, y): sorted(s for h, s, z in rows if (h, z) == (g, y)) for g in ("a", "b", None, "z") for y in (0, 1)}
    want = set((g, t) for g, t in points if t is not None) if own else {(g, t) for _, t in points if t is not None for g in ("a", "b", None)}
    assert {(r.system, r.threshold) for r in found} == want and len(found) == len(want)
    for r in found:
        hits = [len(side[r.system, y]) - bisect.bisect_left(side[r.system, y], r.threshold) for y in (0, 1)]
        assert (r.fp, r.tp) == tuple(hits) and r.tn + r.fp == len(side[r.system, 0]) and r.fn + r.tp == len(side[r.system, 1])


def test_quantiles_over_many_bins(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SPACING", 20)
    rnd = random.Random(3)
    scores = [rnd.choice([0.25, 0.5, rnd.random()]) for _ in range(3000)]
    df = spark.createDataFrame([(s,) for s in scores], "score double")
    found = {r.k: r.threshold for r in calibrate.exact_quantiles(df, "score", 101).collect()}
    assert [found[k] for k in range(101)] == pytest.approx(np.quantile(scores, [k / 100 for k in range(101)]).tolist(), abs=1e-12)
    order = [r.id for r in sampling.shuffled(spark.range(3000), 5).orderBy("sample_order").collect()]
    assert sorted(order) == list(range(3000)) and order[:20] != sorted(order[:20])
