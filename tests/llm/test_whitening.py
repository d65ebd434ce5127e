"""Whitening against numpy over the whole fit list."""

import numpy as np
import pytest

from fringeframe.llm import whitening
from fringeframe.llm.queries import QUERIES
from tests.oracle import DATA

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def _plain(vectors, width, components=4):
    """(n, deviations, whitened, shares) by dense arithmetic on the distinct vectors."""
    x = np.array([[int(np.floor(256 * c)) for c in v] + [0] * (width - len(v)) for v in vectors], object)
    fit = np.array(sorted(set(map(tuple, x))), object)
    n, sums = len(fit), fit.sum(axis=0)
    u = fit * n - sums
    v = np.array([[int(a) / n**3 for a in row] for row in u.T.dot(u)], float)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    centred = np.array(x * n - sums, float) / n
    return n, ((x * n - sums) ** 2).sum(axis=1), centred @ (axes / np.sqrt(values)), values / np.trace(v)


def _held(rows, vectors, keys, width, components=4):
    n, deviation, whitened, shares = _plain(vectors, width, components)
    by = {}
    for r in rows:
        by.setdefault(r["vec_id"], []).append(r)
    assert sorted(by) == sorted(keys)
    signs = [0] * components
    for i, key in enumerate(keys):
        own = sorted(by[key], key=lambda r: r["component"])
        assert [r["component"] for r in own] == list(range(1, components + 1))
        for j, r in enumerate(own):
            assert (r["n"], r["deviation"]) == (n, deviation[i])
            assert r["explained"] == pytest.approx(shares[j], rel=1e-9)
            assert abs(r["whitened"]) == pytest.approx(abs(whitened[i, j]), rel=1e-7, abs=1e-9)
            if abs(whitened[i, j]) > 1e-6:
                sign = np.sign(r["whitened"] * whitened[i, j])
                assert signs[j] in (0, sign)
                signs[j] = sign
            assert r["identity_error"] < 1e-9
    return n


def test_against_dense(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(200, 9)) * np.arange(1, 10) + 40 * np.arange(9)
    vectors = [*base.tolist(), *base[:50].tolist(), base[0].tolist()]  # copies count once in the fit
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], SCHEMA).repartition(7)
    assert _held(whitening.whiten(df).collect(), vectors, range(len(vectors)), 9) == len(np.unique(np.floor(256 * base), axis=0))


def test_floats_far_from_zero_stay_exact(spark):
    """A common offset of 2^22 changes no covariance; squares before centring would lose it in doubles."""
    rng = np.random.default_rng(5)
    base = np.floor(rng.normal(size=(60, 5)) * 300) / 256
    near = {r["vec_id"]: r for r in whitening.whiten(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(base)], SCHEMA), 1).collect()}
    far = whitening.whiten(spark.createDataFrame([(i, (v + 2.0**22).tolist(), 0) for i, v in enumerate(base)], SCHEMA), 1).collect()
    for r in far:
        assert r["deviation"] == near[r["vec_id"]]["deviation"]
        assert abs(r["whitened"]) == pytest.approx(abs(near[r["vec_id"]]["whitened"]), rel=1e-9)


def test_awkward_rows(spark):
    rng = np.random.default_rng(6)
    good = [(i, rng.normal(size=3).tolist(), None) for i in range(30)]
    good += [(3, [0.5, -0.25], 1), (None, [1.0, 2.0, 3.0], 1), (40, [-0.0, 0.0, 0.0], 1), (41, [], 1)]
    bad = [(50, None, 1), (51, [1.0, None, 2.0], 1), (52, [1.0, float("nan"), 2.0], 1), (53, [float("inf"), 1.0, 2.0], 1)]
    df = spark.createDataFrame([(*r, 1, 2, "p") for r in good + bad], SCHEMA + ", n int, component int, x string")
    out = whitening.whiten(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = out.collect()
    assert len(rows) == 3 * len(good) and {r["vec_id"] for r in rows} == {r[0] for r in good}
    single = [(i, v) for i, v, _ in good if i != 3]
    n, deviation, whitened, _ = _plain([v for _, v, _ in good], 3, 3)
    for (i, v, _), d, w in zip(good, deviation, whitened):
        own = [r for r in rows if r["vec_id"] == i]
        assert {r["n"] for r in own} == {n} and d in {r["deviation"] for r in own}
        if (i, v) in single:
            assert sorted(abs(r["whitened"]) for r in own) == pytest.approx(sorted(np.abs(w)), rel=1e-7, abs=1e-9)


def test_without_variance_or_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (3, None, 0)], SCHEMA)
    for part in (df, df.limit(0), df.filter("vec_id = 3")):
        out = whitening.whiten(part)
        assert out.count() == 0 and out.columns[0] == "vec_id"
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0], 0) for i in range(9)], SCHEMA)
    assert {r["component"] for r in whitening.whiten(line).collect()} == {1}


def test_covariance_by_polarisation():
    rng = np.random.default_rng(8)
    x = rng.integers(-500, 500, (70, 6))
    sums = x.sum(axis=0)
    middle = np.array([(2 * s + 70) // 140 for s in sums])
    squares = list(whitening._polarised(middle)(x))
    v, trace = whitening.covariance(70, [int(s - 70 * m) for s, m in zip(sums, middle)], [int(s) for s in squares])
    assert np.allclose(v, np.cov(x.T, bias=True), rtol=1e-12, atol=1e-9) and trace == pytest.approx(np.trace(v))


def test_wide_sums_stay_exact():
    y = np.array([[2**40, 3], [2**40 + 1, -5]])
    assert whitening._square_sums(y).tolist() == [2**80 + (2**40 + 1) ** 2, 34]


def test_query(spark):
    rows = QUERIES["op12_embedding_whitening"](spark, str(DATA / "sf0.001")).collect()
    source = spark.read.parquet(str(DATA / "sf0.001/embeddings.parquet")).orderBy("vec_id").collect()
    _held(rows, [r["embedding"] for r in source], [r["vec_id"] for r in source], 64)
