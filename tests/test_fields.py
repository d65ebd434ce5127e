"""Small fields are one task's, and tasks grow in number with the rows."""

import numpy as np
import pytest

from fringeframe.operators import detect as H


def _refused(*_args, **_kwargs):
    raise AssertionError("a small field took the way of large ones")


def _points(spark, n, fields, name, seed):
    rng = np.random.default_rng(seed)
    rows = [(f, i, float(x), float(y)) for f in range(fields) for i, (x, y) in enumerate(rng.integers(0, 60, (n, 2)) / 2)]
    return rows, spark.createDataFrame(rows, f"field_id bigint, {name} bigint, x double, y double")


@pytest.mark.parametrize("radius", [2.0, 40.0])
def test_nearest_centers_of_small_and_large_fields(spark, monkeypatch, radius):
    refs, a = _points(spark, 30, 4, "ref_id", 1)
    dets, b = _points(spark, 50, 3, "det_id", 2)
    want = set()
    for f, i, x, y in refs:
        found = [(float(np.sqrt((x - u) * (x - u) + (y - v) * (y - v))), j) for g, j, u, v in dets if g == f]
        if found and min(found)[0] <= radius:
            want.add((f, i, min(found)[1], min(found)[0]))
    assert {tuple(r) for r in H.nearest_centers(a, b, [1.0, radius], field_limit=1).collect()} == want
    monkeypatch.setattr(H, "candidate_pairs", _refused)
    assert {tuple(r) for r in H.nearest_centers(a, b, [1.0, radius]).collect()} == want
    agreement = H.center_agreement(a, b, field_limit=1).collect()
    monkeypatch.setattr(H, "nearest", _refused)
    assert sorted(map(tuple, H.center_agreement(a, b).select("field_id", "references", "within_2px", "within_5px", "max_distance").collect()), key=str) == sorted(
        ((r["field_id"], r["references"], r["within_2px"], r["within_5px"], r["max_distance"]) for r in agreement), key=str
    )


def test_nearest_skips_unusable_rows_and_merges_repeated_points(spark):
    a = spark.createDataFrame([(1, 1, None, 1.0), (1, 3, 1.0, 1.0), (1, 3, 8.0, 1.0), (None, 4, 1.0, 1.0)], "field_id int, ref_id int, x double, y double")
    b = spark.createDataFrame([(1, 7, 1.0, 5.0), (1, 8, None, 1.0), (1, 9, float("inf"), 1.0), (1, 10, 9.0, 1.0), (None, 11, 1.0, 1.0)], "field_id int, det_id int, x double, y double")
    assert [tuple(r) for r in H.nearest_centers(a, b, [20.0]).collect()] == [(1, 3, 10, 1.0)]
    assert H.nearest_centers(a, b.limit(0), [20.0]).count() == 0 == H.nearest_centers(a.limit(0), b, [20.0]).count()


def test_tasks_of_suppression_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "FIELDS_PER_TASK", 10)
    _, centers = _points(spark, 60, 5, "det_id", 3)
    boxes = centers.selectExpr("*", "x bx", "y by", "4.0D bw", "3.0D bh", "1.0D / (1 + det_id) score", "1.0D / (1 + det_id) joint")
    for kept in (H.nms_boxes(boxes, 0.3), H.suppress_centers(boxes, 5.0)):
        assert kept.rdd.getNumPartitions() >= 30
    for few, many in ((H.nms_boxes(boxes, 0.3), H.nms_boxes(boxes, 0.3, field_limit=1)), (H.suppress_centers(boxes, 5.0), H.suppress_centers(boxes, 5.0, field_limit=1))):
        assert {tuple(r) for r in few.select("field_id", "det_id").collect()} == {tuple(r) for r in many.select("field_id", "det_id").collect()}
