"""The projection and the layer against plain NumPy."""

import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from glyphward.operators import layered, models


def sparse_rows(spark, n=300, features=90, seed=1):
    """Rows with some strong directions, as vectors of both kinds, and the same as a matrix."""
    rng = np.random.default_rng(seed)
    dense = np.where(rng.random((n, features)) < 0.15, rng.gamma(1, 1, (n, features)), 0.0)
    dense[: n // 2, :20] += np.where(rng.random((n // 2, 20)) < 0.5, 2.0, 0.0)
    dense[5 % n] = 0
    rows = [(str(i), int(i % 3 == 0), Vectors.dense(r) if i % 10 == 0 else Vectors.sparse(features, np.flatnonzero(r), r[np.flatnonzero(r)])) for i, r in enumerate(dense)]
    return spark.createDataFrame(rows, ["key", "label", "features"]).repartition(7), dense


@pytest.mark.parametrize("entries", [50, 1 << 17])
def test_products(spark, monkeypatch, entries):
    monkeypatch.setattr(layered, "ENTRIES", entries)
    df, dense = sparse_rows(spark, 60)
    right = np.random.default_rng(0).normal(size=(90, 4))
    assert np.allclose(layered._squared_times(df, "features", right), dense.T @ (dense @ right))
    r = layered._triangle(df, "features", right)
    assert np.allclose(r.T @ r, (dense @ right).T @ (dense @ right))


def test_svd_equals_a_dense_one(spark, monkeypatch):
    monkeypatch.setattr(layered, "BLOCK", 16)
    monkeypatch.setattr(layered, "FAN", 2)  # several merges
    df, dense = sparse_rows(spark)
    values, vectors = layered.truncated_svd(df, "features", 90, 20, iterations=12)
    u, s, vt = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(values, s[:20], rtol=1e-3)
    assert np.allclose(vectors.T @ vectors, np.eye(20), atol=1e-9)
    assert (vectors[np.abs(vectors).argmax(axis=0), range(20)] > 0).all()
    assert np.allclose(np.abs(vt[:3] @ vectors[:, :3]), np.eye(3), atol=1e-3)
    assert np.linalg.norm(dense - dense @ vectors @ vectors.T) < 1.01 * np.linalg.norm(dense - u[:, :20] * s[:20] @ vt[:20])


def test_orthonormal_bases():
    rng = np.random.default_rng(1)
    for matrix in (rng.normal(size=(500, 30)), rng.normal(size=(500, 30)) * 10.0 ** -np.arange(30), np.ones((500, 3))):
        basis = layered.orthonormal(matrix)
        assert np.allclose(basis.T @ basis, np.eye(matrix.shape[1]), atol=1e-10) and np.allclose(basis @ (basis.T @ matrix), matrix, atol=1e-9)


def test_svd_of_few_rows(spark):
    df, dense = sparse_rows(spark, 4)
    values, vectors = layered.truncated_svd(df.limit(4), "features", 90, 20)
    assert np.allclose(values, np.linalg.svd(dense)[1][:3]) and len(values) == 3 == vectors.shape[1]  # one row is empty
    assert len(layered.truncated_svd(df.limit(0), "features", 90, 20)[0]) == 0


def plain_adam(batches, aside, order, weights, epochs, hidden, patience=3, tolerance=1e-4, rate=1e-3, decay=1e-4):
    """Adam with every gradient from differences of the loss's terms, written apart from the library."""
    w1, b1, w2, b2 = (np.array(w) for w in weights)
    m = [np.zeros_like(w) for w in (w1, b1, w2, b2)]
    v = [np.zeros_like(w) for w in (w1, b1, w2, b2)]
    out, best, idle, step = [], -1, 0, 0
    for _ in range(epochs):
        losses = []
        for k in order.permutation(sorted(batches)):
            x, y = batches[k]
            z = x @ w1 + b1
            a = z * (z > 0)
            p = 1 / (1 + np.exp(-(a @ w2 + b2)))
            losses.append((len(x), -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + decay / 2 * (np.sum(w1**2) + np.sum(w2**2)) / len(x)))
            out_error = (p - y) / len(x)
            hidden_error = np.outer(out_error, w2) * (z > 0)
            g = [x.T @ hidden_error + decay * w1 / len(x), hidden_error.sum(0), a.T @ out_error + decay * w2 / len(x), np.array([out_error.sum()])]
            step += 1
            for i, w in enumerate((w1, b1, w2, b2)):
                m[i] = 0.9 * m[i] + 0.1 * g[i]
                v[i] = 0.999 * v[i] + 0.001 * g[i] ** 2
                # epsilon as usual beside the root before its correction
                w -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8 / np.sqrt(1 - 0.999**step))
        x, y = aside
        score = np.mean(((np.maximum(x @ w1 + b1, 0) @ w2 + b2) >= 0) == y)
        out.append((sum(n * l for n, l in losses) / sum(n for n, _ in losses), score))
        idle = 0 if score >= best + tolerance else idle + 1
        best = max(best, score)
        if idle > patience:
            break
    return out


def test_losses_equal_a_plain_version(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(400) < 0.1)).astype(int)
    df = spark.createDataFrame([(str(i), int(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y))], "key string, label int, x array<double>").repartition(5)
    found = layered.train(df, 6, hidden=8, epochs=30, batch=60, rate=0.03, patience=2, seed=7)
    parts = {}
    for r in layered.dealt(df, "key", 60, 7).collect():
        parts.setdefault(r.batch, []).append((r.x, r.label))
    parts = {b: (np.array([a for a, _ in rows]), np.array([c for _, c in rows])) for b, rows in parts.items()}
    aside = parts.pop(layered.HELD_OUT)
    assert 20 < len(aside[0]) < 60 and len(parts) == 6
    want = plain_adam(parts, aside, np.random.default_rng(8), layered.first_weights(6, 8, 7), 30, 8, patience=2, rate=0.03)
    assert [h[1] for h in found.history] == pytest.approx([w[0] for w in want], rel=1e-6)
    assert [h[2] for h in found.history] == pytest.approx([w[1] for w in want])
    best = max(h[2] for h in found.history)
    assert np.mean((layered.chances(found.weights, aside[0]) >= 0.5) == aside[1]) == best > 0.5


def test_gradients_by_differences():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(9, 3)), rng.integers(0, 2, 9).astype(float)
    weights = layered.first_weights(3, 4, 1)
    found = layered.gradients(weights, x, y)
    at = 2
    for i, w in enumerate(weights):
        for k in range(w.size):
            moved = [np.array(u) for u in weights]
            moved[i].flat[k] += 1e-6
            assert found[at] == pytest.approx((layered.gradients(moved, x, y)[1] - found[1]) / 1e-6, abs=1e-3)
            at += 1


def test_layered_model_learns_and_is_saved(spark, tmp_path):
    rnd = random.Random(3)
    word = lambda y: rnd.choice(["vile awful", "bad nasty"] if y else ["kind nice", "good lovely"])
    rows = [(k, f"{word(k % 2)} {rnd.choice('abcdefgh')} {rnd.choice('stuvwxyz')}{k % 5}", k % 2) for k in range(240)]
    df = spark.createDataFrame(rows, "id int, text string, label int").repartition(4)
    model = models.fit(df, "char", "layers", components=12, hidden=8, epochs=12, batch=40, rate=0.05)
    scored = models.probability(model, df.withColumn("other", F.lit("x"))).collect()
    right = sum((r.probability >= 0.5) == r.label for r in scored)
    assert right >= 230 and {r.other for r in scored} == {"x"} and len(scored) == 240, (right, model.history)
    model.save(spark, f"{tmp_path}/m")
    again = layered.LayeredModel.load(spark, f"{tmp_path}/m")
    assert {r.id: r.probability for r in again.probability(df).collect()} == pytest.approx({r.id: r.probability for r in scored})
    x = np.random.default_rng(1).normal(3, 2, (50, 4))
    a = layered._of(x[:20])
    n, mean, square = layered._merged(a, layered._of(x[20:]))
    assert n == 50 and np.allclose(mean, x.mean(0)) and np.allclose(square / 50, x.var(0))
