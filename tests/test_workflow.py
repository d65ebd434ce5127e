"""Tiled crops against plain slices, and the measurement as one plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeframe.operators import spatial as D
from fringeframe.operators import workflow as W

FRAME = "field_id int, band int, height int, width int, pixels array<double>"


def _frames(spark, shapes):
    rng = np.random.default_rng(2)
    images = {(f, b): rng.random((h, w)) for f, b, h, w in shapes}
    return images, spark.createDataFrame([(f, b, *x.shape, x.ravel().tolist()) for (f, b), x in images.items()], FRAME)


@pytest.mark.parametrize("tile", [5, 16, 256])
@pytest.mark.parametrize("size,circular", [(8, True), (7, False)])
def test_crops_over_tile_borders(spark, tile, size, circular):
    images, frames = _frames(spark, [(1, 0, 40, 61), (1, 1, 40, 61), (2, 0, 17, 16), (3, 0, 9, 9)])
    half = size // 2
    dets = [(1, i, float(x), float(y)) for i, (x, y) in enumerate([(half, half), (61 - size + half, 40 - size + half), (16, 16), (20, 30), (20, 30)])] + [(2, 90, 8.0, 9.0), (9, 91, 5.0, 5.0)]
    got = D.crop_rois(frames, spark.createDataFrame(dets, "field_id int, det_id int, x double, y double"), "field_id", size, circular, tile)
    assert set(got.columns) == {*frames.columns, "det_id"}
    rows = {(r["det_id"], r["band"]): r for r in got.collect()}
    assert len(rows) == 2 * 5 + 1
    yy, xx = np.mgrid[:size, :size]
    mask = (yy - half) ** 2 + (xx - half) ** 2 <= half * half if circular else np.ones((size, size), bool)
    for f, i, x, y in dets[:-1]:
        for band in (0, 1) if f == 1 else (0,):
            window = images[f, band][int(y) - half : int(y) - half + size, int(x) - half : int(x) - half + size]
            assert np.array_equal(np.reshape(rows[i, band]["pixels"], (size, size)), np.where(mask, window, 0.0))


@pytest.mark.parametrize("x,y", [(3.0, 20.0), (-500.0, 20.0), (59.0, 20.0), (20.0, 5_000.0)])
def test_window_outside_fails(spark, x, y):
    _, frames = _frames(spark, [(1, 0, 40, 61)])
    dets = spark.createDataFrame([(1, 1, x, y)], "field_id int, det_id int, x double, y double")
    with pytest.raises(Exception, match="crop outside the frame"):
        D.crop_rois(frames, dets, "field_id", 8, False, 16).collect()


def test_many_detections_on_a_full_frame(spark):
    """Crops are made from tiles: the rows that are joined hold a tile, not the frame of 786,432 pixels."""
    images, frames = _frames(spark, [(1, 0, 768, 1024)])
    cut = D.tiles(frames, 64)
    assert cut.count() == 12 * 16 and cut.agg(F.max(F.size("pixels"))).first()[0] == 64 * 64
    rng = np.random.default_rng(1)
    at = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.integers(10, 1014, 3_000), rng.integers(10, 758, 3_000)))]
    got = D.crop_rois(frames, spark.createDataFrame(at, "field_id int, det_id int, x double, y double"), "field_id", 20, False, 64)
    sums = {r["det_id"]: r["s"] for r in got.select("det_id", F.aggregate("pixels", F.lit(0.0), lambda s, v: s + v).alias("s")).collect()}
    for _, i, x, y in at:
        assert sums[i] == pytest.approx(images[1, 0][int(y) - 10 : int(y) + 10, int(x) - 10 : int(x) + 10].sum())


def test_measurement_without_detections_or_frames(spark):
    _, frames = _frames(spark, [(1, 0, 20, 20), (2, 0, 20, 20)])
    model = spark.createDataFrame([([0.0], [1.0], [0, 1], [[1.0], [-1.0]], [0.0, 0.0])], "mean array<double>, scale array<double>, classes array<bigint>, coefficients array<array<double>>, intercepts array<double>")
    dets = spark.createDataFrame([(1, 1, 10.0, 10.0, 0.9, None), (1, 2, 10.0, 11.0, 0.8, 0.9), (2, 3, 10.0, 10.0, 0.1, 0.9), (2, 4, 1.0, 1.0, 0.9, 0.9)], "field_id int, det_id int, x double, y double, box_conf double, kp_conf double")
    run = lambda f, d: W.measure_fields(f, d, model, ["a", "b"], [0], 2, 10.0, 1.0, crop=6, spacing=4.0, size=(20, 20), variant="spectral", tile=8)
    rows = {(r["field_id"], r["label"]): (r["count"], r["total_count"], r["total_concentration"]) for r in run(frames, dets).collect()}
    assert {k: v[1:] for k, v in rows.items()} == {(1, "a"): (1, 11.0), (1, "b"): (1, 11.0), (2, "a"): (0, 0.0), (2, "b"): (0, 0.0)}
    assert rows[1, "a"][0] + rows[1, "b"][0] == 1
    assert run(frames.limit(0), dets).count() == 0 and run(frames, dets.limit(0)).agg(F.sum("count")).first()[0] == 0
