"""Threshold sweeps solve a field once for all thresholds."""

import numpy as np
import pytest

from fringeframe.operators import detect as H


def _tables(spark, n_refs, n_dets, fields=3):
    rng = np.random.default_rng(5)
    point = lambda: (float(rng.uniform(60, 700)), float(rng.uniform(60, 600)))
    refs = [(f, i, *point()) for f in range(fields) for i in range(n_refs)]
    dets = [(f, i, *point(), float(rng.uniform(0.05, 1.0)), float(rng.uniform(0.3, 1.0))) for f in range(fields) for i in range(n_dets)]
    return (
        spark.createDataFrame(refs, "field_id bigint, ref_id bigint, x double, y double"),
        spark.createDataFrame(dets, "field_id bigint, det_id bigint, x double, y double, box_conf double, kp_conf double"),
    )


MARKS = [0.7, 0.1, 0.4]


@pytest.mark.parametrize("n_refs, n_dets, tile", [(30, 25, 2000), (12, 40, 2000), (30, 25, 20)])
def test_nested_matching_equals_one_matching_per_threshold(spark, n_refs, n_dets, tile):
    refs, dets = _tables(spark, n_refs, n_dets)
    dets = H.accepted(H.judge_detections(dets, 0.0, 100, 1024, 768)).select("field_id", "det_id", "x", "y", "joint")
    got = H.match_nested(refs, dets, MARKS, tile).groupBy("threshold", "field_id").agg({"distance": "sum", "*": "count"}).collect()
    got = {(r[0], r[1]): (r["count(1)"], r["sum(distance)"]) for r in got}
    for t in MARKS:
        for r in H.match_hungarian(refs, dets.filter(f"joint >= {t}")).groupBy("field_id").agg({"distance": "sum", "*": "count"}).collect():
            assert got.pop((t, r[0])) == (r["count(1)"], pytest.approx(r["sum(distance)"]))
    assert not got


def test_sweep_solves_every_field_once(spark, monkeypatch):
    refs, dets = _tables(spark, 20, 30)
    calls = []
    monkeypatch.setattr(H, "match_hungarian", lambda *a, **k: calls.append(a))
    out = {r["threshold"]: r for r in H.threshold_sweep(dets, refs, MARKS, 100, 20.0, 1024, 768).collect()}
    assert not calls and sorted(out) == sorted(MARKS)
    for t in MARKS:
        strong = H.accepted(H.judge_detections(dets.filter(f"box_conf >= {t} AND kp_conf >= {t}"), 0.0, 100, 1024, 768))
        assert out[t]["predicted_centers"] == H.suppress_centers(strong.select("field_id", "det_id", "x", "y", "joint"), 20.0).count()
        assert out[t]["ground_truth_centers"] == 60
