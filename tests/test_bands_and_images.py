import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeframe.functions import arrays as A
from fringeframe.operators import bands as B
from fringeframe.operators import ml as M
from fringeframe.operators import spatial as D
from fringeframe.operators import spectral as S
from fringeframe.operators.neighbours import nearest_rows


def table(n=60, p=12, seed=0, classes=3):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % classes
    x = rng.normal(size=(n, p)) + np.outer(y, np.linspace(0, 1.5, p))
    return x, y


def spectra(spark, x, y, parts=3):
    rows = [(int(i), int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "sample_id bigint, class_index bigint, spectrum array<double>").repartition(parts)


def scores(df):
    return np.array([r["score"] for r in df.orderBy("band").collect()])


def test_vip_equals_nipals(spark):
    x, y = table()
    onehot = np.eye(3)[y]
    xs = (x - x.mean(0)) / x.std(0, ddof=1)
    ys = (onehot - onehot.mean(0)) / onehot.std(0, ddof=1)
    ws, share = [], []
    for _ in range(12):
        u = ys[:, [0]]
        if np.linalg.norm(xs.T @ ys) < 1e-9:
            break
        for _ in range(5000):
            w = xs.T @ u
            w /= np.linalg.norm(w)
            t = xs @ w
            c = ys.T @ t / (t.T @ t)
            u = ys @ c / (c.T @ c)
        p = xs.T @ t / (t.T @ t)
        xs, ys = xs - t @ p.T, ys - t @ c.T
        ws.append(w.ravel())
        share.append(float((t.T @ t).item() * (c.T @ c).item()))
    w2 = np.array(ws).T ** 2
    want = np.sqrt(12 * (w2 @ share) / np.sum(share))
    assert np.allclose(scores(B.pls_vip(spectra(spark, x, y), [0, 1, 2])), want, rtol=2e-3)


def test_spa_equals_successive_projection(spark):
    x, y = table(p=9)
    left = x - x.mean(0)
    order = []
    for _ in range(9):
        norms = (left**2).sum(0)
        norms[order] = -1
        b = int(norms.argmax())
        order.append(b)
        v = left[:, [b]]
        left = left - v @ (v.T @ left) / max(float((v.T @ v).item()), 1e-300)
    want = np.empty(9)
    want[order] = 1 - np.arange(9) / 9
    assert np.allclose(scores(B.spa_rank(spectra(spark, x, y), [0, 1, 2])), want)


def digamma(n):
    return -0.5772156649015329 + sum(1.0 / i for i in range(1, int(n)))


def test_mutual_information_with_ties(spark):
    x, y = table(40, 3)
    x[:, 1] = np.round(x[:, 1])
    want = []
    for b in range(3):
        v, terms = x[:, b], []
        for i in range(len(v)):
            own = np.sort(np.abs(v[(y == y[i]) & (np.arange(len(v)) != i)] - v[i]))
            radius = own[2]
            gaps = np.abs(v - v[i])
            terms.append((3, (y == y[i]).sum(), (gaps == 0).sum() if radius == 0 else (gaps < radius).sum()))
        k, n, m = (np.mean([digamma(t[j]) for t in terms]) for j in range(3))
        want.append(max(0.0, digamma(len(v)) + k - n - m))
    assert np.allclose(scores(B.mutual_info(spectra(spark, x, y), block=8)), want, atol=1e-9)


def test_nearest_rows_in_small_blocks(spark):
    x, y = table(50, 4)
    df = M.as_features(spectra(spark, x, y))
    got = nearest_rows(df, df.filter("sample_id < 7"), 3, exclude_self=True, block=8).collect()
    for q in range(7):
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        assert [r["row_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == list(np.argsort(d)[:3])


def test_zero_distance_decides(spark):
    rows = [(0, 0, [0.0]), (1, 1, [0.1]), (2, 1, [0.1])]
    train = spark.createDataFrame(rows, "sample_id bigint, class_index bigint, features array<double>")
    test = spark.createDataFrame([(9, 1, [0.0])], train.schema)
    assert M.knn_classify(train, test, 3).first()["predicted_index"] == 0


def test_min_gap_shortfall(spark):
    df = spark.createDataFrame([(0, 3.0, 411.0), (1, 2.0, 412.0), (2, 1.0, 420.0)], "band bigint, score double, wavelength_nm double")
    got = B.select_min_gap(df, 3, 5.0, strict=False).collect()
    assert [r["band"] for r in got] == [0, 2]
    with pytest.raises(Exception, match="fewer than 3"):
        B.select_min_gap(df, 3, 5.0).collect()


def test_rbf_features_approach_the_kernel(spark):
    x, y = table(20, 3)
    df = M.as_features(spectra(spark, x, y))
    z, _ = M.fourier_features(df, df, size=8000, gamma=0.3)
    f = np.array([r["features"] for r in z.orderBy("sample_id").collect()])
    want = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(f @ f.T - want).max() < 0.06


def images(spark, cubes=4, bands=5, side=6, seed=1):
    rng = np.random.default_rng(seed)
    data = rng.random((cubes, bands, side, side)) * 10
    rows = [(c, c % 2, b, side, side, data[c, b].ravel().tolist()) for c in range(cubes) for b in range(bands)]
    return data, spark.createDataFrame(
        rows, "cube_id bigint, class_index bigint, band bigint, height int, width int, pixels array<double>"
    ).repartition(3)


def test_principal_component_equals_eigh(spark):
    data, df = images(spark)
    for r in D.pca_first_component(df).collect():
        flat = data[r["cube_id"]].reshape(5, -1)
        z = (flat - flat.mean(1, keepdims=True)) / (flat.std(1, keepdims=True) + 1e-6)
        w = np.linalg.eigh(z @ z.T / (z.shape[1] - 1))[1][:, -1]
        w = -w if w.sum() < 0 else w
        assert np.allclose(r["pixels"], w @ z, atol=1e-9)


def test_gradient_equals_numpy(spark):
    data, df = images(spark)
    out = df.withColumn("g", D.gradient_magnitude(F.col("pixels"), F.col("height"), F.col("width"))).collect()
    for r in out:
        gy, gx = np.gradient(data[r["cube_id"], r["band"]])
        assert np.allclose(r["g"], np.hypot(gx, gy).ravel())


def test_augmentation_noise_is_repeatable(spark):
    data, df = images(spark)
    make = lambda d: {(r["class_index"], r["item"], r["band"]): r["pixels"] for r in D.augment(d, 6, 11, 5, noise=0.05).collect()}
    a, b = make(df), make(df.repartition(7))
    assert a == b and len(a) == 2 * 6 * 5
    clean = {(r["class_index"], r["item"], r["band"]): r["pixels"] for r in D.augment(df, 6, 11, 5, noise=0.0).collect()}
    diff = np.array([np.array(a[k]) - np.array(clean[k]) for k in a]).ravel()
    positive = np.array([a[k] for k in a]).ravel() > 0.5
    spread = np.mean([max(1.0, np.std([clean[k] for k in clean if k[:2] == g])) for g in {k[:2] for k in a}])
    assert abs(diff[positive].mean()) < 0.03 and diff[positive].std() == pytest.approx(0.05 * spread, rel=0.15)


def test_fixed_optics_numbers(spark):
    df = spark.createDataFrame([(411.0 + i,) for i in range(369)], "wavelength_nm double")
    r = D.geometry_report(df, 100, 100).first()
    assert r["fresnel_length_px_min"] == pytest.approx(32.380077018980394)
    assert r["fresnel_length_px_max"] == pytest.approx(44.578525076085505)
    assert r["fresnel_number_radius_25um"] == pytest.approx(0.21008403361344533)
    assert r["crop_width_um"] == pytest.approx(140.0)


def test_ring_support_sees_rings(spark):
    y, x = np.mgrid[:100, :100] - 49.5
    rings = np.abs(np.cos(np.hypot(y, x) * 0.6)) * (np.hypot(y, x) < 43)
    flat = np.ones((100, 100))
    df = spark.createDataFrame([(1, rings.ravel().tolist()), (2, flat.ravel().tolist()), (3, [1.0])], "patch_id int, energy array<double>")
    got = {r["patch_id"]: r["support"] for r in D.ring_support(df, 100).collect()}
    assert got[1] > 1.0 and got[2] < 1e-6 and got[3] == 0.0


def test_array_edges(spark):
    df = spark.createDataFrame([([],), ([2.0],), ([float("nan"), 1.0, float("inf")],), (None,)], "a array<double>")
    got = df.select(A.minmax(F.col("a")), A.mean(F.col("a")), S.nonzero_mean(F.col("a"))).collect()
    assert got[0][0] == [] and got[0][1] is None and got[0][2] == 0.0
    assert got[1][0] == [0.0] and got[1][1] == 2.0
    assert got[2][0] == [0.0, 1.0, 0.0] and got[3][0] is None


def test_lag_tie_and_overlap(spark):
    flat = [1.0] * 40
    df = spark.createDataFrame([(flat, flat), (flat[:10], flat[:10])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(S.best_lag(F.col("a"), F.col("b"), 5)).collect()] == [-5, 0]
    base = np.exp(-((np.arange(80) - 40) ** 2) / 30).tolist()
    moved = np.exp(-((np.arange(80) - 36) ** 2) / 30).tolist()
    pair = spark.createDataFrame([(base, moved)], "a array<double>, b array<double>")
    assert pair.select(S.best_lag(F.col("a"), F.col("b"), 8)).first()[0] == 4


def test_normaliser_is_exact_on_large_cubes(spark):
    rng = np.random.default_rng(4)
    pixels = rng.normal(size=(3, 100 * 100)) ** 3
    rows = [(1, 0, b, 100, 100, p.tolist()) for b, p in enumerate(pixels)]
    images = spark.createDataFrame(rows, "cube_id bigint, class_index int, band int, height int, width int, pixels array<double>")
    found = D.fit_normaliser(images).first()
    assert np.allclose([found["low"], found["high"]], np.percentile(pixels, [0.5, 99.5]), rtol=1e-12)
