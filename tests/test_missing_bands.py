"""Cubes that lack bands: features keep their places, what a missing band would give is left out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeframe.operators import ml as M
from fringeframe.operators import spatial as D
from fringeframe.sources import envi

SCHEMA = "cube_id bigint, class_index bigint, band bigint, height int, width int, pixels array<double>"


def cubes(spark, bands, side=4, seed=3):
    """One cube per list of bands, with positive pixels; the same (cube, band) has the same pixels."""
    rows = [
        (cube, 0, band, side, side, (np.random.default_rng([seed, cube, band]).random(side * side) + 0.1).tolist())
        for cube, own in enumerate(bands)
        for band in own
    ]
    return spark.createDataFrame(rows, SCHEMA)


def features(df):
    return {r["cube_id"]: r["features"] for r in df.collect()}


def test_features_keep_their_places(spark):
    images = cubes(spark, [range(6), [1, 4, 5], [0, 3], [4]])
    found = features(D.features(images, [1, 4, 2], 2))
    assert all(len(f) == 3 + 3 * 2 + 6 for f in found.values())
    means = {(r["cube_id"], r["band"]): np.mean(r["pixels"]) for r in images.collect()}
    two = np.array([means[1, 1], means[1, 4]])
    assert found[1][:2] == pytest.approx((two - two.mean()) / (two.std() + 1e-6)) and found[1][2] is None
    assert None not in found[0] and found[1][7:9] == [None, None] and None not in found[1][3:7]
    assert found[2][:9] == [None] * 9 and found[2][9] == pytest.approx(np.mean([means[2, 0], means[2, 3]]))
    assert found[3][1] == pytest.approx(0.0) and found[3][0] is None


def test_selected_wavelengths_need_both_frames(spark):
    images = cubes(spark, [range(9), [1, 2, 4, 7], [0, 1, 3], [4, 7, 8]])
    found = features(D.features_selected_only(images, [411 + 1.5, 415.0, 411 + 7.25], (411.0, 420.0, 10), 2))
    assert set(found) == {0, 1, 3} and all(len(f) == 3 + 3 * 2 for f in found.values())
    assert None not in found[0]
    assert found[1][2] is None and found[1][7:] == [None, None] and None not in found[1][:2] + found[1][3:7]
    assert found[3][0] is None and found[3][3:5] == [None, None]
    # The places that are there agree with those of the whole cube's frames.
    whole = features(D.features_selected_only(cubes(spark, [range(9), range(9)]), [411 + 1.5, 415.0], (411.0, 420.0, 10), 2))
    assert found[1][:2] == pytest.approx(whole[1][:2]) and found[1][3:7] == pytest.approx(whole[1][2:])


def test_manifest_compares_the_bands_a_cube_has(spark):
    images = cubes(spark, [range(5), range(5), [0, 3, 4]])
    rows = {r["cube_id"]: r for r in D.cube_manifest(images, D.fit_normaliser(images)).collect()}
    scaled = D.normalise(images, D.fit_normaliser(images)).collect()
    level = {(r["cube_id"], r["band"]): np.mean(r["pixels"]) for r in scaled}
    mean = {b: np.mean([v for (_c, band), v in level.items() if band == b]) for b in range(5)}
    for cube, own in ((0, range(5)), (2, [0, 3, 4])):
        v, m = np.array([level[cube, b] for b in own]), np.array([mean[b] for b in own])
        assert rows[cube]["cosine"] == pytest.approx(v @ m / np.sqrt((v @ v) * (m @ m)))


def test_missing_features_add_nothing_to_a_score(spark):
    model = spark.createDataFrame(
        [([1.0, 2.0], [2.0, 1.0], [0, 1], [[1.0, 1.0], [2.0, -1.0]], [0.5, 0.0])],
        "mean array<double>, scale array<double>, classes array<bigint>, coefficients array<array<double>>, intercepts array<double>",
    )
    rows = spark.createDataFrame([(0, [3.0, 2.0]), (1, [3.0, None]), (2, [None, None])], "id bigint, features array<double>")
    found = {r["id"]: r for r in M.score_linear(rows, model).collect()}
    assert found[0]["scores"] == found[1]["scores"] == [1.5, 2.0] and found[1]["predicted_index"] == 1
    assert found[2]["predicted_index"] is None


def test_cubes_without_some_bands_come_back(spark, tmp_path):
    axis = [400.0, 410.0, 420.0, 430.0]
    images = cubes(spark, [range(4), [1, 3], [0]]).withColumn("wavelength_nm", F.element_at(F.array(*[F.lit(v) for v in axis]), (F.col("band") + 1).cast("int")))
    path = str(tmp_path / "cubes")
    envi.write_envi(images, path, (4, 4, 4), axis=axis)
    back = {(int(r["cube_id"]), r["band"]): r for r in envi.read_envi(spark, path, skip_bad=True).collect()}
    want = {(r["cube_id"], r["band"]): r for r in images.collect()}
    assert set(back) == set(want)
    for key, row in back.items():
        assert row["bands"] == 4 and row["wavelength_nm"] == want[key]["wavelength_nm"]
        assert row["pixels"] == pytest.approx(want[key]["pixels"], rel=1e-6)
    every = {(int(r["cube_id"]), r["band"]): r["pixels"] for r in envi.read_envi(spark, path).collect()}
    assert len(every) == 12 and set(every[1, 0]) == {0.0} and (tmp_path / "cubes" / "2.raw").stat().st_size == 4 * 16 * 4
    assert {key for key in back if key[1] in (1, 2)} == {(int(r["cube_id"]), r["band"]) for r in envi.read_envi(spark, path, bands=[1, 2], skip_bad=True).collect()}
    with pytest.raises(Exception, match="template"):
        envi.write_envi(images, str(tmp_path / "strict"), (4, 4, 4))
