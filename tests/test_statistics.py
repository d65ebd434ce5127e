import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeframe.functions.distributions import incomplete_beta, t_quantile, t_two_sided
from fringeframe.operators import calibrate as G
from fringeframe.operators import evaluate as E


def test_t_distribution_constants():
    known = {1: 12.706204736432095, 4: 2.7764451051977987, 10: 2.2281388519649385, 30: 2.0422724563012373}
    for df, value in known.items():
        assert math.isclose(t_quantile(0.975, df), value, rel_tol=1e-10)
        assert math.isclose(t_two_sided(value, df), 0.05, rel_tol=1e-9)
    assert incomplete_beta(2, 3, 0.5) == pytest.approx(0.6875, abs=1e-14)


def test_exact_line(spark):
    df = spark.createDataFrame([(float(x), 100.0 * x + 7.0) for x in range(1, 7)], "x double, y double")
    fit = G.ols(df, "x", "y").first()
    assert fit["slope"] == pytest.approx(100) and fit["intercept"] == pytest.approx(7) and fit["r2"] == pytest.approx(1)
    for r in G.leave_one_out(df, "x", "y").collect():
        assert r["loo_prediction"] == pytest.approx(r["y"])
    with pytest.raises(Exception, match="varying x"):
        G.ols(df.withColumn("x", F.lit(2.0)), "x", "y").collect()
    with pytest.raises(Exception, match="varying x"):
        G.ols(df.limit(2), "x", "y").collect()


def test_leave_one_out_equals_refits(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=12)
    y = 3 * x + rng.normal(size=12)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    for r in G.leave_one_out(df, "x", "y").collect():
        keep = x != r["x"]
        slope, intercept = np.polyfit(x[keep], y[keep], 1)
        assert r["loo_prediction"] == pytest.approx(slope * r["x"] + intercept, rel=1e-9)


def test_ranks_and_correlation(spark):
    x = [1.0, 2.0, 2.0, 3.0, 5.0, 5.0, 5.0]
    y = [2.0, 1.0, 4.0, 4.0, 6.0, 5.0, 9.0]
    df = spark.createDataFrame(list(zip(x, y)), "x double, y double")
    rank = lambda v: np.array([np.mean([i + 1 for i, s in enumerate(sorted(v)) if s == e]) for e in v])
    got = G.correlations(df, "x", "y").first()
    assert got["spearman_rho"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    r = np.corrcoef(x, y)[0, 1]
    assert got["pearson_p"] == pytest.approx(t_two_sided(r * math.sqrt(5 / (1 - r * r)), 5))


def test_preparation_rules(spark):
    rows = []
    for prep, missing, flags in (("a", 0, 5), ("b", 5, 5), ("c", 1, 5), ("d", 0, 4)):
        for f in range(1, 6):
            rows.append(("C1", prep, f, 1 if f <= flags else 0, None if f <= missing else float(f), 100.0 * f, None if f == 1 else 9.0))
    df = spark.createDataFrame(
        rows, "gradient_id string, preparation_id string, field_id int, include_flag int, ring_count double, reference_conc double, target double"
    )
    got = {r["preparation_id"]: r for r in G.preparation_status(G.preparations(df)).collect()}
    assert [got[p]["analysis_status"] for p in "abcd"] == [
        "Included", "Excluded: ring counts missing", "Excluded: paired measurements incomplete", "Excluded: paired measurements incomplete",
    ]
    assert got["a"]["target"] == 9.0
    with pytest.raises(Exception, match="at least four"):
        G.map_gradients(G.preparations(df)).collect()


def test_concentration_rules():
    assert G.geometric_slope(4.0, 10.0, 50.0) == pytest.approx(1250.0)
    assert G.inverted_line(2.0, 4.0) == (0.5, -2.0)
    with pytest.raises(ValueError):
        G.estimate(F.lit(1), 0.0, 1.0)


def test_mcnemar_and_holm(spark):
    assert E.exact_mcnemar(0, 0) == 1.0
    assert E.exact_mcnemar(10, 0) == pytest.approx(2 / 2**10, rel=1e-12)
    for b, c in ((3, 9), (50, 70), (7, 7)):
        n, k = b + c, min(b, c)
        direct = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
        assert E.exact_mcnemar(b, c) == pytest.approx(direct, rel=1e-10)
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03)], "id int, p double")
    got = {r["id"]: r["p_holm"] for r in E.holm(df, "p", "id").collect()}
    assert [got[i] for i in (1, 2, 3)] == pytest.approx([0.03, 0.06, 0.06])


def wide(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    t = rng.integers(0, 3, n)
    a = np.where(rng.random(n) < 0.8, t, (t + 1) % 3)
    b = np.where(rng.random(n) < 0.7, t, (t + 2) % 3)
    return t, a, b, spark.createDataFrame([tuple(map(int, r)) for r in zip(range(n), t, a, b)], "sample_id int, t int, a int, b int")


def test_paired_bootstrap_matches_row_resampling(spark):
    t, a, b, df = wide(spark)
    got = E.paired_bootstrap(df, "t", "a", "b", [0, 1, 2], 2000, 5).first()
    rng = np.random.default_rng(0)
    deltas = []
    for _ in range(2000):
        i = rng.integers(0, len(t), len(t))
        deltas.append(np.mean(t[i] == a[i]) - np.mean(t[i] == b[i]))
    low, high = np.percentile(deltas, [2.5, 97.5])
    assert got["accuracy_delta_ci_low"] == pytest.approx(low, abs=0.012)
    assert got["accuracy_delta_ci_high"] == pytest.approx(high, abs=0.012)
    again = E.paired_bootstrap(df.repartition(5), "t", "a", "b", [0, 1, 2], 2000, 5).first()
    assert got == again


def test_bootstrap_drops_absent_classes(spark):
    df = spark.createDataFrame([(0, 0)] * 10, "t int, a int")
    got = E.bootstrap_ci(df, "t", "a", [0, 1, 2], 50, 1).first()
    assert got["macro_f1_ci_low"] == 1.0 and got["accuracy_ci_high"] == 1.0


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([("m", 0, 1), ("m", 1, 1), ("m", 1, 2)], "model string, true_index int, predicted_index int")
    got = E.metrics(df, ["model"]).first()
    assert got["accuracy"] == pytest.approx(1 / 3)
    assert got["balanced_accuracy"] == pytest.approx(0.25)
    assert got["macro_f1"] == pytest.approx((0 + 0.5 + 0) / 3)
    same = spark.createDataFrame([("m", 0, 0)], "model string, true_index int, predicted_index int")
    assert E.metrics(same, ["model"]).first()["mcc"] == 0.0


def test_pairs_need_the_same_samples(spark):
    df = spark.createDataFrame([("a", 1, 0, 0), ("a", 2, 0, 0), ("b", 1, 0, 0)], "model string, sample_id int, true_index int, predicted_index int")
    with pytest.raises(Exception, match="different samples"):
        E.paired_tables(df, [("a", "b")]).collect()


def test_explode_slots_in_chunks(spark):
    df = spark.createDataFrame([(1, 10), (2, 3)], "k int, n bigint")
    got = E.explode_slots(df, "n", "slot", chunk=4).groupBy("k").agg(F.count("slot"), F.min("slot"), F.max("slot")).collect()
    assert sorted(map(tuple, got)) == [(1, 10, 0, 9), (2, 3, 0, 2)]


def test_labels_out_of_the_list_are_wrong_and_not_another_label(spark):
    rows = [(i % 3, [0, 1, 2][i % 3] if i % 4 else 9) for i in range(12)] + [(7, 7)]
    cells = [{"t": a, "p": b, "n": 5} for a, b in rows]
    accuracy, f1 = E._resample(cells, 0, 1, ["t", "p"], np.array([0, 1, 2]), True)
    drawn = np.random.default_rng([1, 0]).multinomial(65, np.full(13, 1 / 13))
    hit = np.array([a == b for a, b in rows])
    assert accuracy == pytest.approx(drawn[hit].sum() / 65)
    scores = []
    for c in (0, 1, 2):
        t, p = (np.array([r[k] == c for r in rows]) for k in (0, 1))
        scores.append(2 * drawn[t & p].sum() / (drawn[t].sum() + drawn[p].sum()))
    assert f1 == pytest.approx(np.mean(scores))


def test_models_must_cover_the_same_samples_once(spark):
    kind = "sample_id bigint, model string, seed bigint, true_index bigint, predicted_index bigint"
    rows = [(i, m, 0, i % 2, i % 2) for i in range(6) for m in ("a", "b")]
    assert E.seed_summary(spark.createDataFrame(rows, kind)).count() == 2
    with pytest.raises(Exception, match="different samples"):
        E.seed_summary(spark.createDataFrame(rows[:-1], kind)).collect()
    with pytest.raises(Exception, match="more than once"):
        E.paired_tables(spark.createDataFrame([*rows, rows[0]], kind), [("a", "b")]).collect()
