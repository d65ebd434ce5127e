"""Bootstrap sums by hierarchical multinomials: exact counts, repeatability, and the distribution of plain resampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeframe.operators import calibrate as G, evaluate as E
from fringeframe.operators.calibrate import stratified_draws
from fringeframe.operators.resample import hashed_lines, resampled_lines, resampled_sums


def _rows(spark, n=600):
    rng = np.random.default_rng(4)
    rows = [("abc"[i % 3] if i % 7 else "a", i, float(x), float(3 * x + e)) for i, (x, e) in enumerate(zip(rng.normal(5, 2, n), rng.normal(0, 1, n)))]
    return rows, spark.createDataFrame(rows, "g string, k bigint, x double, y double")


@pytest.mark.parametrize("size", [40, 16_384])
def test_every_iteration_draws_each_stratum_as_often_as_it_has_rows(spark, size):
    rows, df = _rows(spark)
    flags = df.select("g", "k", *[(F.col("g") == g).cast("int").alias(g) for g in "abc"], (F.col("k") * 0 + 1).alias("one"), "x")
    out = resampled_sums(flags, "g", "k", ["a", "b", "c", "one", "x"], 600, 1, size).toPandas()
    assert sorted(out.iteration) == list(range(600)) and (out.one == len(rows)).all()
    for g in "abc":
        assert (out[g] == sum(r[0] == g for r in rows)).all()
    x = np.array([r[2] for r in rows])
    spread = np.sqrt(sum(np.var(x[[r[0] == g for r in rows]]) * sum(r[0] == g for r in rows) for g in "abc"))
    assert out.x.mean() == pytest.approx(x.sum(), abs=4 * spread / np.sqrt(600)) and out.x.std() == pytest.approx(spread, rel=0.15)
    assert out.x.nunique() == 600


def test_repeatable_under_any_partitioning(spark):
    _, df = _rows(spark)
    first = resampled_sums(df.repartition(7), "g", "k", ["x", "y"], 300, 9, 50)
    again = resampled_sums(df.orderBy("x").coalesce(1), "g", "k", ["x", "y"], 300, 9, 50)
    assert first.exceptAll(again).isEmpty() and first.count() == 300
    assert not resampled_sums(df, "g", "k", ["x", "y"], 300, 10, 50).exceptAll(first).isEmpty()


def test_lines_have_the_intervals_of_hashed_draws(spark):
    _, df = _rows(spark, 200)
    new = G.stratified_bootstrap(df, "x", "y", "g", "k", 1_500).first()
    old = G.stratified_bootstrap_hashed(df, "x", "y", "g", "k", 1_500).first()
    assert (new["iterations"], new["degenerate"]) == (1_500, 0)
    for c in ("slope", "intercept"):
        width = old[f"{c}_ci_high"] - old[f"{c}_ci_low"]
        for side in ("low", "high"):
            assert new[f"{c}_ci_{side}"] == pytest.approx(old[f"{c}_ci_{side}"], abs=0.15 * width)


def test_lines_far_from_zero_and_degenerate_draws(spark):
    rows = [("a", i, 1e9 + i, 2e9 + 5.0 * i) for i in range(3)] + [("b", 7, None, 1.0)]
    df = spark.createDataFrame(rows, "g string, k bigint, x double, y double")
    out = resampled_lines(df, "x", "y", "g", "k", 200, 3).collect()
    assert len(out) == 200
    flat = [r for r in out if r["slope"] is None]
    assert 5 < len(flat) < 50  # one of nine draws takes the same row three times
    assert all(r["slope"] == pytest.approx(5.0) and r["intercept"] == pytest.approx(2e9 - 5e9, rel=1e-6) for r in out if r["slope"] is not None)
    assert resampled_lines(df.limit(0), "x", "y", "g", "k", 200, 3).count() == 0


def test_clusters(spark):
    rng = np.random.default_rng(5)
    rows = [(int(c), 1, int(rng.random() < 0.2 + c / 50)) for c in rng.integers(0, 30, 3_000)]
    df = spark.createDataFrame(rows, "c int, true_index int, predicted_index int")
    new, old = E.cluster_bootstrap(df, "c", 1_500).first(), E.cluster_bootstrap_hashed(df, "c", 1_500).first()
    assert new["accuracy"] == old["accuracy"] and new["iterations"] == 1_500
    for side in ("accuracy_ci_low", "accuracy_ci_high"):
        assert new[side] == pytest.approx(old[side], abs=0.02)


def test_hashed_draws_pick_the_rows_their_hashes_name(spark):
    import hashlib

    rng = np.random.default_rng(5)
    rows = [("ab"[i % 2], i, float(x), float(3 * x + e)) for i, (x, e) in enumerate(zip(rng.random(90), rng.normal(size=90)))]
    rows += [(None, 100, 50.0, -70.0), ("a", 101, None, 5.0)]
    df = spark.createDataFrame(rows, "g string, k bigint, x double, y double")
    strata = {g: sorted(r[1:] for r in rows if r[0] == g) for g in "ab"}
    ranked = spark.createDataFrame([(g, i, r[1], r[2]) for g, own in strata.items() for i, r in enumerate(own)], "stratum string, pick bigint, x double, y double")
    sizes = spark.createDataFrame([(g, len(own)) for g, own in strata.items()], "stratum string, size bigint")
    want = {}
    for i in range(6):
        got = []
        for g, own in strata.items():
            for j in range(len(own)):
                got.append(own[int(hashlib.sha1(f"9|{i}|{g}|{j}".encode()).hexdigest()[:8], 16) % len(own)])
        pairs = np.array([r[1:] for r in got if r[1] is not None])
        want[i] = np.polyfit(pairs[:, 0], pairs[:, 1], 1)
    for found in (hashed_lines(ranked, sizes, 6, 9, rows=7, slots=10), stratified_draws(df, "x", "y", "g", "k", 6, 9)):
        found = {r["iteration"]: (r["slope"], r["intercept"]) for r in found.collect()}
        assert set(found) == set(want) and all(found[i] == pytest.approx(tuple(want[i])) for i in want)
