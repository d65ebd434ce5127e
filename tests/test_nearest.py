"""Nearest centers by the cell pyramid against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeframe.operators import detect as H
from fringeframe.operators.nearest import nearest


def _frames(spark, points, centers):
    a = spark.createDataFrame([(int(f), i, float(x), float(y)) for i, (f, x, y) in enumerate(points)], "f bigint, id bigint, x double, y double")
    b = spark.createDataFrame([(int(f), i, float(x), float(y)) for i, (f, x, y) in enumerate(centers)], "f bigint, det_id bigint, x double, y double")
    return a, b


def _plain(points, centers):
    out = {}
    for i, (f, x, y) in enumerate(points):
        found = [(np.sqrt((x - u) * (x - u) + (y - v) * (y - v)), j) for j, (g, u, v) in enumerate(centers) if g == f]
        if found:
            out[i] = min(found)
    return out


def _held(spark, points, centers, leaf=64):
    got = nearest(*_frames(spark, points, centers), ["f"], leaf).collect()
    want = _plain(points, centers)
    assert len(got) == len(want)
    for r in got:
        assert (r["distance"], r["det_id"]) == want[r["id"]]


@pytest.mark.parametrize("leaf", [2, 64])
def test_scattered_clustered_and_far(spark, leaf):
    """Dense clusters, empty space, ties on a lattice, copies, and points far outside of all centers."""
    rng = np.random.default_rng(leaf)
    centers = [(1, *p) for p in rng.random((150, 2)) * 1000] + [(1, *p) for p in 700 + rng.normal(size=(150, 2))]
    centers += [(2, x, y) for x in range(0, 80, 10) for y in range(0, 80, 10)] + [(2, 10, 10)] * 5
    centers += [(3, 5, 5)] * 3 + [(4, x, 0) for x in (0, 1, 2, 100_000)]
    points = [(1, *p) for p in rng.random((60, 2)) * 1000] + [(1, *p) for p in 700 + rng.normal(size=(40, 2))] + [(1, -5e4, 3.0), (1, 9e4, 9e4)]
    points += [(2, x, y) for x in (0, 5, 15, 33, 200) for y in (-7, 5, 25)] + [(3, 5, 5), (3, -1e5, 0), (4, 50_000.75, 9), (4, 60_000, -9e5), (5, 1, 1)]
    _held(spark, points, centers, leaf)


def test_unusable_rows(spark):
    a = spark.createDataFrame([(1, 1, None, 1.0, "p"), (1, 2, float("nan"), 1.0, "p"), (1, 3, 1.0, 1.0, "p"), (1, 3, 8.0, 1.0, "p")], "f int, id int, x double, y double, level string")
    b = spark.createDataFrame([(1, 7, 1.0, 5.0), (1, 8, None, 1.0), (1, 9, float("inf"), 1.0), (1, 10, 9.0, 1.0)], "f int, det_id int, x double, y double")
    assert [tuple(r) for r in nearest(a, b, ["f"]).collect()] == [(1, 3, 10, 1.0)]
    assert nearest(a, b.limit(0), ["f"]).count() == 0 == nearest(a.limit(0), b, ["f"]).count()


def test_agreement_counts_far_references(spark):
    refs = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 3.0, 0.0), (1, 3, 0.0, 50_000.0), (2, 4, 1.0, 1.0)], "field_id int, ref_id int, x double, y double")
    dets = spark.createDataFrame([(1, 7, 0.0, 0.0)], "field_id int, det_id int, x double, y double")
    rows = {r["field_id"]: r for r in H.center_agreement(refs, dets).collect()}
    assert (rows[1]["references"], rows[1]["within_2px"], rows[1]["within_5px"], rows[1]["max_distance"]) == (3, 1, 2, 50_000.0)
    assert (rows[2]["references"], rows[2]["within_2px"], rows[2]["mean_distance"]) == (1, 0, None)


def test_few_candidates_beside_a_dense_cluster(spark):
    """Thousands of centers in a spot that all points have to look at from afar: each compares a few of them."""
    rng = np.random.default_rng(9)
    points = [(1, *p) for p in np.stack([np.full(50, 5_000.0), np.linspace(0, 500, 50)], 1)]
    centers = [(1, *p) for p in rng.random((4_000, 2)) * 20]
    _held(spark, points, centers, 8)
