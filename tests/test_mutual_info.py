"""Mutual information of bands sorted in one task, and of larger ones by ranks."""

import numpy as np

from fringeframe.operators import bands as B


def test_both_ways_agree_and_small_bands_are_not_ranked(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, int(i % 3 if i < 60 else 9 + i), [float(v) for v in (rng.normal() + i % 3, round(rng.normal()), 1.0)]) for i in range(62)]
    spectra = spark.createDataFrame(rows, "sample_id bigint, class_index bigint, spectrum array<double>")
    by_rank = {r["band"]: r["score"] for r in B.mutual_info(spectra, block=8, band_limit=1).collect()}

    def refused(*_args, **_kwargs):
        raise AssertionError("a small band was ranked by joins")

    monkeypatch.setattr(B, "group_rank", refused)
    monkeypatch.setattr(B, "running_total", refused)
    by_band = {r["band"]: r["score"] for r in B.mutual_info(spectra).collect()}
    assert sorted(by_band) == [0, 1, 2] and all(np.isclose(by_band[b], by_rank[b], atol=1e-12) for b in by_band)
