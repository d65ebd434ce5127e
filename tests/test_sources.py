import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeframe.sources import envi, frames, labels, tables


def cube_rows(spark, data, axis, name="sample_1"):
    bands, lines, samples = data.shape
    rows = [(name, b, float(axis[b]), data[b].ravel().tolist()) for b in range(bands)]
    return spark.createDataFrame(rows, "cube_id string, band int, wavelength_nm double, pixels array<double>")


def test_round_trip(spark, tmp_path):
    data = np.random.default_rng(0).random((8, 24, 32)).astype("f4")
    data[0, 0, 0] = np.nan
    axis = np.linspace(411, 779, 8)
    envi.write_envi(cube_rows(spark, data, axis), str(tmp_path), (8, 24, 32))
    back = envi.read_envi(spark, str(tmp_path)).orderBy("band").collect()
    data[0, 0, 0] = 0
    assert np.array_equal(np.array([r["pixels"] for r in back], dtype="f4"), data.reshape(8, -1))
    assert np.allclose([r["wavelength_nm"] for r in back], axis, atol=1e-4)
    assert (back[0]["lines"], back[0]["samples"]) == (24, 32)
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".part")]
    some = envi.read_envi(spark, str(tmp_path), bands=[5]).collect()
    assert len(some) == 1 and np.array_equal(np.array(some[0]["pixels"], dtype="f4"), data[5].ravel())


@pytest.mark.parametrize("code,kind", sorted(envi.DATA_TYPES.items()))
@pytest.mark.parametrize("interleave", ["bsq", "bil", "bip"])
def test_decoding(code, kind, interleave, tmp_path):
    """The kernel of the reader: every type and layout, both byte orders, trailing bytes ignored."""
    data = np.arange(3 * 2 * 4).reshape(3, 2, 4)
    order = {"bsq": (0, 1, 2), "bil": (1, 0, 2), "bip": (1, 2, 0)}[interleave]
    from pyarrow import fs

    for byte_order, mark in ((0, "<"), (1, ">")):
        raw = tmp_path / f"{byte_order}.raw"
        raw.write_bytes(data.transpose(order).astype(np.dtype(kind).newbyteorder(mark)).tobytes() + b"xx")
        text = f"ENVI\nsamples = 4\nLines   = 2\nbands = 3\ndata type = {code}\ninterleave = {interleave}\nbyte order = {byte_order}\n"
        meta = envi.parse_header(text, (400.0, 800.0))
        assert meta["wavelengths"] == [400.0, 600.0, 800.0]
        with fs.LocalFileSystem().open_input_file(str(raw)) as handle:
            got = dict(envi.read_bands(handle, meta, [2, 0]))
        assert np.array_equal(got[2], data[2].ravel()) and np.array_equal(got[0], data[0].ravel())


class Counting:
    """A file that counts the bytes it hands out."""

    def __init__(self, data: bytes):
        self.data, self.at, self.read_bytes = data, 0, 0

    def size(self):
        return len(self.data)

    def seek(self, at):
        self.at = at

    def read(self, size):
        part = self.data[self.at : self.at + size]
        self.at += len(part)
        self.read_bytes += len(part)
        return part


@pytest.mark.parametrize("interleave", ["bsq", "bil", "bip"])
def test_bytes_read_for_some_bands(interleave, monkeypatch):
    """One band of twelve costs a twelfth of the file, but for pixel-interleaved cubes; small blocks and groups change nothing."""
    data = np.random.default_rng(3).integers(0, 999, (12, 7, 5)).astype("<u2")
    order = {"bsq": (0, 1, 2), "bil": (1, 0, 2), "bip": (1, 2, 0)}[interleave]
    raw = data.transpose(order).tobytes()
    meta = envi.parse_header(f"samples = 5\nlines = 7\nbands = 12\ndata type = 12\ninterleave = {interleave}\n", (400.0, 800.0))
    for block, image in ((envi.BLOCK_BYTES, envi.IMAGE_BYTES), (250, 300)):
        monkeypatch.setattr(envi, "BLOCK_BYTES", block)
        monkeypatch.setattr(envi, "IMAGE_BYTES", image)
        for wanted in ([4], [11, 0, 1], [3, 3], [], list(range(12))):
            handle = Counting(raw)
            got = list(envi.read_bands(handle, meta, wanted))
            assert [b for b, _ in got] == wanted and all(np.array_equal(image, data[b].ravel()) for b, image in got)
            if interleave != "bip" and len(wanted) == len(set(wanted)) < 12:
                assert handle.read_bytes == len(raw) * len(wanted) // 12
    assert envi.BLOCK_BYTES == 250


def test_filters_reach_the_files(spark, tmp_path):
    data = np.random.default_rng(4).random((6, 4, 3)).astype("f4")
    for name in ("a", "b", "c"):
        envi.write_envi(cube_rows(spark, data, np.linspace(411, 779, 6), name), str(tmp_path), (6, 4, 3))
    cubes = envi.read_envi(spark, str(tmp_path))
    asked = {
        "band = 3": 3,
        "band in (1, 4) and cube_id = 'b'": 2,
        "band > 1 and band <= 3 and cube_id in ('a', 'c')": 4,
        "cube_id <> 'a' and not band in (0, 1, 2)": 6,
        "band = 9": 0,
        "cube_id = 'none'": 0,
        "wavelength_nm > 700": 6,
    }
    every = [(r["cube_id"], r["band"], r["wavelength_nm"], r["pixels"]) for r in cubes.collect()]
    whole = spark.createDataFrame(every, "cube_id string, band int, wavelength_nm double, pixels array<float>")
    for condition, n in asked.items():
        got = cubes.filter(condition).select(*whole.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.filter(condition).collect())) and got.count() == n
    # A cube that the filter rules out is not opened: this one is too short to be read.
    (tmp_path / "d.hdr").write_text((tmp_path / "a.hdr").read_text())
    (tmp_path / "d.raw").write_bytes(b"1234")
    assert cubes.filter("cube_id < 'd' and band = 0").count() == 3
    with pytest.raises(Exception, match="too short"):
        cubes.filter("band = 0").collect()


def test_partitions_are_cut_by_bytes(spark, tmp_path):
    data = np.zeros((6, 4, 3), "f4")
    for name in ("a", "b", "c", "d", "e"):
        envi.write_envi(cube_rows(spark, data, np.linspace(411, 779, 6), name), str(tmp_path), (6, 4, 3))
    sizes = lambda limit: [len(p.headers) for p in envi.EnviReader({"path": str(tmp_path), "partition_bytes": limit}).partitions()]
    assert sizes(2 * data.nbytes) == [2, 2, 1] and sizes(1) == [1] * 5 and sizes(1 << 30) == [5]


def test_bad_cubes(spark, tmp_path):
    with pytest.raises(ValueError, match="wavelength per band"):
        envi.parse_header("samples = 1\nlines = 1\nbands = 2\ndata type = 4\nwavelength = {1.0}\n", None)
    with pytest.raises(ValueError, match="data type"):
        envi.parse_header("samples = 1\nlines = 1\nbands = 2\ndata type = 9\n", (1, 2))
    (tmp_path / "a.hdr").write_text("samples = 4\nlines = 4\nbands = 2\ndata type = 4\n")
    (tmp_path / "a.raw").write_bytes(b"1234")
    with pytest.raises(Exception, match="too short"):
        envi.read_envi(spark, str(tmp_path), (411.0, 779.0)).collect()
    data = np.zeros((2, 3, 3))
    with pytest.raises(Exception, match="template"):
        envi.write_envi(cube_rows(spark, data, [1, 2]), str(tmp_path / "out"), (3, 3, 3))


def png(path, array):
    h, w = array.shape[:2]
    rgb = array.ndim == 3
    raw = b"".join(b"\0" + array[y].astype("u1").tobytes() for y in range(h))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if rgb else 0, 0, 0, 0))
        + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    )


def test_frames(spark, tmp_path):
    rng = np.random.default_rng(1)
    gray, color = rng.integers(0, 256, (5, 7)), rng.integers(0, 256, (5, 7, 3))
    png(tmp_path / "scan_a" / "pos_-4.png", gray)
    png(tmp_path / "scan_a" / "pos_8.png", color)
    (tmp_path / "scan_a" / "notes.txt").write_text("x")
    listed = {r["position"]: r for r in frames.list_frames(spark, str(tmp_path)).collect()}
    assert set(listed) == {-4, 8} and listed[-4]["scan_id"] == "scan_a"
    rows = {r["position"]: r for r in frames.read_frames(spark, str(tmp_path)).collect()}
    assert np.array_equal(np.array(rows[-4]["pixels"]).reshape(5, 7), gray)
    luma = (19595 * color[..., 0] + 38470 * color[..., 1] + 7471 * color[..., 2] + 32768) >> 16
    assert np.array_equal(np.array(rows[8]["pixels"]).reshape(5, 7), luma)
    (tmp_path / "scan_b").mkdir()
    (tmp_path / "scan_b" / "pos_1.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="not an image"):
        frames.read_frames(spark, str(tmp_path)).collect()
    bad = spark.createDataFrame([("/s/pos_1x.png",)], "path string")
    with pytest.raises(Exception, match="pos_<integer>"):
        frames.parse_frames(bad).collect()


def test_frames_to_cubes(spark):
    rows = [("/d/A/r1/10.png", 2), ("/d/A/r1/2.png", 2), ("/d/A/r1/cover.png", 2), ("/d/A/r1/COVER.png", 2), ("/d/A/r2/1.png", 2), ("/d/B/r3/1.png", 2)]
    df = spark.createDataFrame([(p, s, s, [float(i)] * 4) for i, (p, s) in enumerate(rows)], "path string, height int, width int, pixels array<double>")
    got = frames.frames_to_cubes(df, 1).orderBy("cube_id", "band").collect()
    assert [(r["cube_id"], r["band"], r["pixels"][0]) for r in got][:2] == [("r1", 0, 1.0), ("r1", 1, 0.0)]
    assert {r["cube_id"] for r in got} == {"r1", "r3"} and len(got) == 4
    uneven = df.withColumn("height", F.when(F.col("path").endswith("/2.png"), 3).otherwise(F.col("height")))
    with pytest.raises(Exception, match="unequal shape"):
        frames.frames_to_cubes(uneven).collect()


def test_labels(spark, tmp_path):
    (tmp_path / "a.txt").write_text("﻿0 0.5 0.25 0.1 0.1\n\n0 0 0 0 0 0.1 0.2 2\n0 0.5 0.5 0 0 9 9 0\n0 300 200 5 5\n", encoding="utf-8")
    got = sorted((r["x"], r["y"]) for r in labels.read_centers(spark, str(tmp_path), 100, 80).collect())
    assert np.allclose(got, [(10.0, 16.0), (50.0, 20.0), (50.0, 40.0), (300.0, 200.0)])
    with pytest.raises(Exception, match="invalid label"):
        labels.parse_center_lines(spark.createDataFrame([("0 1 2",)], "line string"), 1, 1).collect()
    df = spark.createDataFrame([(-5.0, 40.0)], "x double, y double")
    assert labels.box_lines(df, 100, 80, 10).first()["line"] == "0 0.00000000 0.50000000 0.10000000 0.12500000"
    assert labels.box_lines(df, 100, 80, 10, F.lit(3), inset=True).first()["line"].startswith("3 0.05000000 ")


def test_calibration_json_and_csv(spark, tmp_path):
    body = {"values": [["gradient_id", "ring_count", "include_flag"], ["C0", "1.5", "1"], ["C1", "bad", ""]]}
    (tmp_path / "c.json").write_text(json.dumps(body, indent=1))
    rows = tables.read_calibration(spark, str(tmp_path / "c.json")).orderBy("gradient_id").collect()
    assert [tuple(r) for r in rows] == [("C0", 1.5, 1.0), ("C1", None, None)]
    (tmp_path / "c.csv").write_text("gradient_id,ring_count\nC0,NaN\n")
    assert tables.read_calibration(spark, str(tmp_path / "c.csv")).first()["ring_count"] is None


def test_band_list_and_manifest(spark, tmp_path):
    (tmp_path / "b.csv").write_text("rank,band_index\n1,2\n")
    with pytest.raises(ValueError, match="wavelength_nm"):
        tables.read_bands(spark, str(tmp_path / "b.csv"))
    (tmp_path / "m.json").write_text(json.dumps({"mode": "single", "runs": [{"image": "a"}]}))
    with pytest.raises(Exception, match="not a batch manifest"):
        tables.read_manifest(spark, str(tmp_path / "m.json")).collect()


def test_cache_keys_on_configuration(spark, tmp_path):
    base = str(tmp_path)
    one = tables.cached(spark.range(3).toDF("v"), base, {"k": 1})
    assert one.count() == 3
    assert tables.cached(spark.range(9).toDF("v"), base, {"k": 1}).count() == 3
    assert tables.cached(spark.range(9).toDF("v"), base, {"k": 2}).count() == 9
    assert tables.cached(spark.range(5).toDF("v"), base, {"k": 1}, rebuild=True).count() == 5


def test_export_keeps_empty_images(spark):
    images = spark.createDataFrame([(1,), (2,)], "field_id int")
    dets = spark.createDataFrame([(1, 3.0, 4.0, 0.5, 0.6, 0.5)], "field_id int, x double, y double, box_conf double, kp_conf double, joint double")
    got = {r["field_id"]: r for r in tables.centers_export(images, dets, "field_id", {"threshold": 0.25}).collect()}
    assert got[1]["count"] == 1 and got[2]["count"] == 0 and got[2]["centers"] == [] and got[1]["settings"]["threshold"] == 0.25


def test_an_aborted_cache_is_written_again(spark, tmp_path):
    rows = spark.range(7).toDF("v")
    assert tables.cached(rows, str(tmp_path), {"k": 1}).count() == 7
    (folder,) = tmp_path.iterdir()
    for file in folder.iterdir():
        file.unlink()
    (folder / "_temporary").mkdir()
    assert tables.cached(rows, str(tmp_path), {"k": 1}).count() == 7


def test_header_lists_may_have_exponents_and_lines():
    text = "ENVI\nsamples = 2\nlines = 1\nbands = 3\ndata type = 4\nWavelength = {4.11e+02,\n 412.5, -1.5E-1}\ndescription = {a, b}\n"
    assert envi.parse_header(text, None)["wavelengths"] == [411.0, 412.5, -0.15]
