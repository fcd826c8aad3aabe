"""Hard negatives against all scores, and the bounds against the scores they hold."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphward.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=hn.ANCHORS_EVERY):
    clean = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        clean.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    key = lambda s, i: (-s, i is None, i or 0)
    out = []
    for a, va, la in (r for k, r in enumerate(clean) if r not in clean[:k]):
        if a is None or a % every:
            continue
        scored = sorted(((sum(x * y for x, y in zip(va, v)), i, label) for i, v, label in clean if i != a), key=lambda r: key(r[0], r[1]))
        for score, positive, _ in [r for r in scored if r[2] == la][:5]:
            window = [r for r in scored if r[2] != la and 30 * score <= 100 * r[0] <= 90 * score][:10]
            out += [(a, positive, rank + 1, i, score, s) for rank, (s, i, _) in enumerate(window)]
    return sorted(out, key=repr)


def vectors(n=700, dims=12, seed=1, labels=10):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 0.2) for _ in range(dims)] for _ in range(labels)]
    rows = []
    for i in range(n):
        label = rnd.randrange(labels)
        rows.append((i, [c + rnd.gauss(0, 0.12) for c in centres[(label + rnd.randrange(2)) % labels]], label))
    return rows


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("group_bytes", [1 << 20, 300])
def test_all_scores(spark, group_bytes, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 64)
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain(rows)
    assert found(hn.mine(df, group_bytes=group_bytes)) == want and len(want) > 100


def test_bounds_hold_and_spare_most_rows():
    rng = np.random.default_rng(3)
    rows = np.floor(rng.normal(0, 32, (4000, 64))).astype(np.int64)
    rows[0, 0], rows[1, 0] = 9000, -9000  # out of the equal cells
    edges = []
    for j in range(64):
        x = rows[:, j]
        inner = np.floor(np.linspace(x.mean() - 4 * x.std(), x.mean() + 4 * x.std(), hn.CELLS - 1)).astype(np.int64)
        edges.append(np.unique(np.concatenate([[x.min()], inner[(inner > x.min()) & (inner <= x.max())], [x.max() + 1]])))
    cells = np.stack([np.searchsorted(e, rows[:, j], "right") - 1 for j, e in enumerate(edges)]).astype(np.uint8)
    ids, labels = np.arange(4000), np.zeros(4000, np.int64)
    block = hn.Block(4000, ids.tobytes(), labels.tobytes(), cells.tobytes(), rows.astype(hn._kind(edges)).tobytes(), edges)
    scored = []
    plain_scores = block.scores
    block.scores = lambda anchor, at: (scored.append(len(at)), plain_scores(anchor, at))[1]
    for k in range(2, 12):
        low, high = block.bounds(rows[k], slice(0, 4000))
        exact = rows @ rows[k]
        assert (low <= exact).all() and (exact <= high).all()
        ids, scores = hn.positives_in(block, k, 0, rows[k])
        want = sorted((-s, i) for i, s in enumerate(exact) if i != k)[:5]
        assert [(-s, i) for i, s in zip(ids, scores)] == want
    assert np.mean(scored) < 400


def test_copies_ties_and_odd_rows(spark, monkeypatch):
    """Many copies of an anchor's vector, repeated rows, null ids, broken rows, short vectors, negative and zero scores,
    clashing columns."""
    monkeypatch.setattr(hn, "BLOCK_ROWS", 50)
    rows = vectors(200, 6, 2, 3)
    rows += [(1000 + k, rows[0][1], k % 3) for k in range(300)]
    rows += [(100, [0.5] * 6, 1), rows[100]] + [(2001, [0.4] * 6, 1)] * 3 + [(2002, [0.2] * 6, 2)] * 3 + [(None, [0.2] * 6, 2)] * 2 + [(None, [0.45] * 6, 1)]
    rows += [(300, [0.0] * 6, 4), (301, [0.0] * 6, 4), (302, [1.0] * 6, 5), (400, [1.0], 6), (401, [-1.0], 6), (402, [1.0, 1.0], 7)]
    rows += [(500, None, 1), (600, [0.1, None], 1), (700, [float("nan")], 1), (800, [float("inf")], 1), (900, [0.1], None), (1100, [], 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({c: F.lit(1) for c in ("id", "v", "k", "n", "place", "rank", "group", "score")})
    assert found(hn.mine(df)) == plain(rows)


def test_empty_tables(spark):
    assert hn.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hn.mine(spark.createDataFrame([(1, [0.5], 1), (100, None, 2)], SCHEMA)).count() == 0
    assert hn.mine(spark.createDataFrame([(100, [0.5], 1)], SCHEMA)).count() == 0


def test_large_components(spark):
    rows = [(100 * k, [float(k * 1000), -500.0 * k, 1.0], k % 2) for k in range(12)]
    assert found(hn.mine(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    with pytest.raises(ValueError, match="too large"):
        hn.mine(spark.createDataFrame([(100, [1e30], 1)], SCHEMA))
