"""Landmark features against the kernel itself and a plain dual solver."""

import numpy as np
import pytest

from fringeframe.operators import kernels as K
from fringeframe.operators import ml as M

SCHEMA = "sample_id bigint, class_index bigint, features array<double>"


def _frame(spark, x, y, first=0):
    return spark.createDataFrame([(first + i, int(c), row.tolist()) for i, (row, c) in enumerate(zip(x, y))], SCHEMA)


def _rings(rng, n):
    y = rng.integers(0, 2, n)
    angle, radius = rng.uniform(0, 2 * np.pi, n), np.where(y == 0, 1.0, 2.5) + rng.normal(0, 0.2, n)
    return np.column_stack([radius * np.cos(angle), radius * np.sin(angle)]), y


def _rbf(a, b, gamma):
    return np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(-1))


def _dual(k, s, c, epochs=100):
    """Coordinate ascent of the hinge dual; the constant in the kernel stands for the intercept."""
    k = k + 1.0
    alpha, f = np.zeros(len(s)), np.zeros(len(s))
    for _ in range(epochs):
        for i in range(len(s)):
            new = min(max(alpha[i] + (1 - s[i] * f[i]) / k[i, i], 0.0), c)
            f += (new - alpha[i]) * s[i] * k[i]
            alpha[i] = new
    return alpha * s


def test_residual_bounds_the_kernel(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    train = _frame(spark, x, np.zeros(200))
    z, again = K.nystroem_features(train, train.repartition(7), landmarks=40, gamma=0.2)
    rows = {r["sample_id"]: r for r in z.collect()}
    f, res = np.array([rows[i]["features"] for i in range(200)]), np.array([rows[i]["residual"] for i in range(200)])
    error = np.abs(_rbf(x, x, 0.2) - f @ f.T)
    assert (error <= np.sqrt(np.outer(res, res)) + 1e-6).all() and res.max() > 0.01
    assert np.sum(res < 1e-6) >= 40
    assert all(np.allclose(r["features"], rows[r["sample_id"]]["features"]) for r in again.collect())
    facts = K.kernel_error(z).first()
    assert facts["n"] == 200 and facts["max_residual"] == pytest.approx(res.max()) and facts["mean_residual"] == pytest.approx(res.mean())


def test_all_rows_as_landmarks_give_the_kernel(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(30, 3))] * 2)
    train = _frame(spark, x, np.zeros(60))
    f = np.array([r["features"] for r in K.nystroem_features(train, train, gamma=0.5)[0].orderBy("sample_id").collect()])
    assert f.shape[1] <= 30 and np.abs(f @ f.T - _rbf(x, x, 0.5)).max() < 1e-6


def test_awkward_rows(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 2.0], 5.0), (2, 1, None, 6.0), (None, 1, [1.0, 2.0], 7.0)], SCHEMA + ", residual double")
    out, none = K.nystroem_features(rows, rows.limit(0), gamma=1.0)
    found = {r["sample_id"]: r for r in out.collect()}
    assert found[2]["features"] is None and found[2]["residual"] is None
    assert found[1]["residual"] == pytest.approx(0) and found[None]["features"] == pytest.approx(found[1]["features"])
    assert none.count() == 0
    with pytest.raises(ValueError, match="no training row"):
        K.nystroem_features(rows.filter("sample_id = 2"), rows)


@pytest.mark.parametrize("c", [0.05, 10.0])
def test_svm_agrees_with_a_plain_dual_solver(spark, c):
    rng = np.random.default_rng(5)
    (x, y), (tx, ty) = _rings(rng, 400), _rings(rng, 500)
    got = {r["sample_id"]: r["predicted_index"] for r in M.fit_predict("svm_rbf", _frame(spark, x, y), _frame(spark, tx, ty), c=c).collect()}
    mean, sd = x.mean(0), x.std(0)
    a, b = (x - mean) / sd, (tx - mean) / sd
    weights = len(y) / (2 * np.bincount(y))[y]
    w = _dual(_rbf(a, a, 0.5), np.where(y == 1, 1.0, -1.0), c * weights.mean())
    want = ((_rbf(b, a, 0.5) + 1.0) @ w > 0).astype(int)
    assert np.mean([got[i] == want[i] for i in range(500)]) > 0.99
