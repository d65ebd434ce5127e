"""Percentiles by digits of the bit pattern against sorted values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeframe.operators import quantiles as Q
from fringeframe.operators.quantiles import quantiles
from fringeframe.operators.skew import group_percentiles

WANTED = {"lo": 0.0, "a": 0.013, "m": 0.5, "b": 0.9, "hi": 1.0}


def _values(n: int):
    """All magnitudes and signs, ties and zeros of both signs."""
    rng = np.random.default_rng(n)
    out = rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n)
    out[::5], out[1::7], out[2::11] = 1.5, 0.0, -0.0
    return out


def test_bit_order():
    x = np.array([-np.inf, -1e300, -2.0, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1e300, np.inf, np.nan])
    b = Q._ordered(x)
    assert (np.diff(b.astype(object)) >= 0).all() and b[4] == b[5]
    assert np.array_equal(Q._doubles(b.view(np.int64)), x, equal_nan=True)


@pytest.mark.parametrize("few", [1, 50, Q.FEW])
def test_rows_by_key(spark, few):
    """However many passes it takes, the result is that of the sorted values."""
    rows = [(k, i, float(v)) for k, n in ((1, 400), (2, 1), (None, 37)) for i, v in enumerate(_values(n))]
    rows += [(1, 0, None), (3, 0, None)]
    df = spark.createDataFrame(rows, "k int, i int, v double").repartition(5)
    got = {r["k"]: r for r in quantiles(df, ["k"], "v", WANTED, few=few).collect()}
    assert sorted(got, key=str) == [1, 2, None]
    for k in got:
        own = np.array([r[2] for r in rows if r[0] == k and r[2] is not None])
        for name, p in WANTED.items():
            assert got[k][name] == pytest.approx(np.quantile(own, p), rel=1e-12, abs=0)


def test_same_as_sorted_way(spark):
    df = spark.range(20_000).select((F.col("id") % 3).alias("k"), (F.pmod(F.xxhash64("id"), F.lit(5000)) / 7.0).alias("v"))
    a, b = quantiles(df, ["k"], "v", WANTED), group_percentiles(df, ["k"], "v", WANTED)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("few", [1, Q.FEW])
def test_arrays_whole_and_by_place(spark, few):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(90, 6)), 2)
    rows = [(int(i % 2), row.tolist()) for i, row in enumerate(x)] + [(0, None), (1, []), (0, [None] * 6)]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    whole = quantiles(df, [], "v", WANTED, few=few).collect()
    assert len(whole) == 1 and whole[0]["m"] == np.quantile(x, 0.5) and whole[0]["a"] == pytest.approx(np.quantile(x, 0.013))
    placed = quantiles(df, ["k"], "v", {"m": 0.5}, by_place=True, place="band", few=few).collect()
    assert len(placed) == 12
    for r in placed:
        assert r["m"] == pytest.approx(np.median(x[r["k"] :: 2, r["band"]]), abs=1e-12)


def test_no_values(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "k int, v array<double>")
    assert quantiles(df, ["k"], "v", WANTED).count() == 0 == quantiles(df.limit(0), [], "v", WANTED).count()
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "v double")
    row = quantiles(nan, [], "v", WANTED).first()
    assert row["m"] == 2.0 and math.isnan(row["hi"])


def test_values_are_counted_before_they_move(spark):
    """A million values leave a few thousand counts: what is shuffled does not grow with the table."""
    df = spark.range(1_000_000).select(((F.col("id") * 7919) % 1_000_003 / 1000.0).alias("v"))
    found = df.select(F.col("v").alias("_v")).mapInArrow(Q._counted([], False, 0, False), "_place bigint, _prefix bigint, _digit bigint, _n bigint")
    once = found.groupBy("_digit").agg(F.sum("_n").alias("n"))
    assert once.count() < 500 and once.agg(F.sum("n")).first()[0] == 1_000_000
    assert quantiles(df, [], "v", {"m": 0.5}).first() == group_percentiles(df, [], "v", {"m": 0.5}).first()
