"""Spectral operators.

Spectra are `sample_id, class_index, spectrum ARRAY<DOUBLE>` in band order: per-sample steps are
expressions on one row and never shuffle; class statistics explode and aggregate with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringeframe.functions import arrays as A
from fringeframe.operators.quantiles import quantiles
from fringeframe.operators.skew import group_rank

# Extra band shift per class label of the training data.
CLASS_SHIFTS = {"CMB": 0, "DWB": -5, "DQB": -12, "WQ": -18, "YMXB": -4}
MAX_LAG = 30
MIN_OVERLAP = 20


def explode_spectra(spectra: DataFrame, value: str = "spectrum", name: str = "intensity") -> DataFrame:
    """Long form: one row per (sample, band)."""
    keep = [c for c in spectra.columns if c != value]
    return spectra.select(*keep, F.posexplode(value).alias("band", name))


def collect_spectra(long: DataFrame, keys: list[str], band: str = "band", value: str = "intensity") -> DataFrame:
    """Array form from long rows, ordered by band inside the aggregate; groups are bounded by the axis."""
    packed = F.sort_array(F.collect_list(F.struct(F.col(band).alias("b"), F.col(value).alias("v"))))
    return long.groupBy(*keys).agg(F.transform(packed, lambda s: s["v"]).alias("spectrum"))


def wavelength_axis(frames: DataFrame, lo: float, hi: float, scan: str = "scan_id") -> DataFrame:
    """Add band_index and wavelength_nm: even steps lo..hi by position rank, `lo` for a single frame."""
    ranked = group_rank(frames, [scan], [F.col("position")], F.col("position"), "_rank")
    sizes = frames.groupBy(scan).agg(F.count(F.lit(1)).alias("_n"))
    step = F.lit(float(hi - lo)) / (F.col("_n") - 1)
    return (
        ranked.join(sizes, scan)
        .withColumn("band_index", F.col("_rank") - 1)
        .withColumn(
            "wavelength_nm",
            F.when(F.col("_n") < 2, F.lit(float(lo))).otherwise(F.lit(float(lo)) + F.col("band_index") * step),
        )
        .drop("_rank", "_n")
    )


def nearest_band(wavelengths: Column, target: Column | float) -> Column:
    """Zero-based band closest to the target; the first on a tie."""
    goal = target if isinstance(target, Column) else F.lit(float(target))
    gaps = A.let(goal, lambda g: F.transform(wavelengths, lambda w: F.abs(w - g)))
    return A.let(gaps, lambda d: F.array_position(d, F.array_min(d)) - 1)


def band_subset(spectrum: Column, bands: int, picks: int) -> Column:
    """Array of (band, intensity) at `picks` even, half-even rounded positions."""
    listed = F.array(*[F.lit(i) for i in A.linspace_rounded(bands, picks)])
    return F.transform(
        listed, lambda i: F.struct(i.cast("bigint").alias("band"), A.at(spectrum, i).alias("intensity"))
    )


def resample(spectrum: Column, axis_start: float, axis_step: float, grid: list[float]) -> Column:
    """Linear resampling of an evenly spaced spectrum, end values held outside the axis."""
    targets = F.array(*[F.lit(float(g)) for g in grid])
    position = lambda g: (g - F.lit(float(axis_start))) / F.lit(float(axis_step))
    return A.let(spectrum, lambda s: F.transform(targets, lambda g: A.interpolate_at(s, position(g))))


def resample_uneven(spectrum: Column, wavelengths: Column, grid: list[float]) -> Column:
    """Linear resampling of a spectrum with its own ascending wavelength array."""
    targets = F.array(*[F.lit(float(g)) for g in grid])

    def value(s: Column, g: Column) -> Column:
        below = F.size(F.filter(s["w"], lambda w: w <= g)) - 1
        left = F.greatest(F.lit(0), F.least(below, F.size(s["w"]) - 1))
        right = F.least(left + 1, F.size(s["w"]) - 1)
        w0, w1, v0, v1 = A.at(s["w"], left), A.at(s["w"], right), A.at(s["v"], left), A.at(s["v"], right)
        return F.when((g <= w0) | (w1 == w0), v0).otherwise(v0 + (v1 - v0) * (g - w0) / (w1 - w0))

    return A.let(
        F.struct(spectrum.alias("v"), wavelengths.alias("w")), lambda s: F.transform(targets, lambda g: value(s, g))
    )


def shift_bands(spectrum: Column, by: Column) -> Column:
    """Move values `by` bands up; vacated bands are NULL."""
    return A.let(
        F.struct(spectrum.alias("s"), by.alias("k")),
        lambda t: F.transform(t["s"], lambda _v, i: F.when(i - t["k"] >= 0, A.at(t["s"], i - t["k"]))),
    )


def shift_fractional(spectrum: Column, by: Column) -> Column:
    """Move values by a fractional number of bands, end values held."""
    return A.let(
        F.struct(spectrum.alias("s"), by.alias("k")),
        lambda t: F.transform(t["s"], lambda _v, i: A.interpolate_at(t["s"], i.cast("double") - t["k"])),
    )


def crop_common(spectra: DataFrame, shift: str, spectrum: str = "spectrum") -> DataFrame:
    """Cut every shifted spectrum to the bands valid under all shifts; adds `first_band`."""
    first = F.greatest(F.lit(0), spectra.agg(F.max(shift)).scalar()).cast("int")
    lost = F.greatest(F.lit(0), -spectra.agg(F.min(shift)).scalar()).cast("int")
    return spectra.withColumn("first_band", first).withColumn(
        spectrum,
        F.slice(spectrum, F.col("first_band") + 1, F.greatest(F.lit(0), F.size(spectrum) - F.col("first_band") - lost)),
    )


def apply_shift_report(spectra: DataFrame, report: DataFrame, key: str = "sample_id") -> DataFrame:
    """Shift each spectrum by its reported `shift_bands`; a sample missing from the report fails the job."""
    joined = spectra.join(report.select(key, "shift_bands"), key, "left").withColumn(
        "shift_bands",
        F.when(F.col("shift_bands").isNull(), F.raise_error(F.lit("missing shift for a sample"))).otherwise(
            F.col("shift_bands")
        ),
    )
    return joined.withColumn("spectrum", shift_bands(F.col("spectrum"), F.col("shift_bands")))


def nonzero_mean(pixels: Column) -> Column:
    """Mean of values above zero, else the plain mean; non-finite results become 0."""
    positive = F.filter(pixels, lambda v: v > 0)
    value = F.coalesce(A.mean(positive), A.mean(pixels))
    return A.let(value, lambda m: F.when(A.finite(m), m).otherwise(F.lit(0.0)))


def count_nonzero_mean(pixels: Column) -> Column:
    """Sum of all values over the count of non-zero values, else the plain mean."""
    hits = F.size(F.filter(pixels, lambda v: v != 0))
    return F.when(hits > 0, A.total(pixels) / hits).otherwise(A.mean(pixels))


def cube_spectra(images: DataFrame, reduce=nonzero_mean) -> DataFrame:
    """One spectrum per cube from one image per band."""
    per_band = images.select("cube_id", "class_index", "band", reduce(F.col("pixels")).alias("intensity"))
    return collect_spectra(per_band, ["cube_id", "class_index"])


def best_lag(reference: Column, sample: Column, max_lag: int = MAX_LAG, min_overlap: int = MIN_OVERLAP) -> Column:
    """Lag in -max..max with the highest mean product of z-scored smoothed gradients.

    Pairs reference[i + lag] with sample[i]; the most negative lag wins a tie, 0 when no lag overlaps enough.
    """
    prepared = lambda a: A.zscore(A.gradient(A.moving_average(a)))

    def scored(s: Column, lag: Column) -> Column:
        products = F.filter(
            F.transform(s["b"], lambda v, i: F.when(i + lag >= 0, A.at(s["a"], i + lag)) * v), lambda p: A.finite(p)
        )
        return A.let(
            products,
            lambda p: F.when(
                F.size(p) >= min_overlap, F.struct((A.total(p) / F.size(p)).alias("score"), (-lag).alias("neg"))
            ),
        )

    best = A.let(
        F.struct(prepared(reference).alias("a"), prepared(sample).alias("b")),
        lambda s: F.array_max(
            F.transform(F.sequence(F.lit(-max_lag), F.lit(max_lag)), lambda lag: scored(s, lag))
        ),
    )
    return F.coalesce(-best["neg"], F.lit(0))


def median_spectra(spectra: DataFrame, key: str = "class_index") -> DataFrame:
    """Exact median spectrum per class."""
    medians = quantiles(spectra, [key], "spectrum", {"intensity": 0.5}, by_place=True, place="band")
    return collect_spectra(medians, [key]).withColumnRenamed("spectrum", "reference")


def align_class(
    spectra: DataFrame,
    extra_shift: Column | None = None,
    max_lag: int = MAX_LAG,
    min_overlap: int = MIN_OVERLAP,
    key: str = "class_index",
) -> DataFrame:
    """Align each spectrum to its class median, add a fixed class shift, NULL what fell off.

    Adds `lag` and `shift_bands` (lag plus class shift). The class shift is for training data only.
    """
    extra = F.lit(0) if extra_shift is None else extra_shift
    joined = spectra.join(median_spectra(spectra, key), key)
    lagged = joined.withColumn("lag", best_lag(F.col("reference"), F.col("spectrum"), max_lag, min_overlap))
    moved = lagged.withColumn("spectrum", shift_bands(shift_bands(F.col("spectrum"), F.col("lag")), extra))
    return moved.withColumn("shift_bands", F.col("lag") + extra).drop("reference")


def class_cv(spectra: DataFrame) -> DataFrame:
    """Per (class, band): n, mean, sample SD and CV% = 100*sd/max(|mean|, eps)."""
    eps = 2.220446049250313e-16
    return (
        explode_spectra(spectra)
        .groupBy("class_index", "band")
        .agg(
            F.count(F.lit(1)).alias("n"), F.avg("intensity").alias("mean"), F.stddev_samp("intensity").alias("sd")
        )
        .withColumn("cv", 100.0 * F.col("sd") / F.greatest(F.abs(F.col("mean")), F.lit(eps)))
    )


def cv_quantiles(cv: DataFrame) -> DataFrame:
    """Distribution of CV% over the bands of each class (bounded by the axis)."""
    marks = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    return cv.groupBy("class_index").agg(
        F.min("cv").alias("cv_min"),
        F.max("cv").alias("cv_max"),
        *[F.percentile("cv", p).alias(f"cv_{name}") for name, p in marks.items()],
    )


def mean_curves(spectra: DataFrame, classes: list[int]) -> DataFrame:
    """Wide export: one row per band, one mean curve per class, samples weighted equally."""
    long = explode_spectra(spectra.select("class_index", "spectrum"))
    means = long.groupBy("band").pivot("class_index", classes).agg(F.avg("intensity"))
    return means.select("band", *[F.col(f"`{c}`").alias(f"class_{c}") for c in classes])


def curve_agreement(curves: DataFrame, archived: DataFrame, classes: list[int], rtol: float = 1e-12) -> DataFrame:
    """Per band: do all class curves agree with an archived table within rtol?"""
    other = archived.select("band", *[F.col(f"class_{c}").alias(f"_a{c}") for c in classes])
    ok = F.lit(True)
    for c in classes:
        ok = ok & (F.abs(F.col(f"class_{c}") - F.col(f"_a{c}")) <= rtol * F.abs(F.col(f"_a{c}")))
    return curves.join(other, "band", "left").select("band", F.coalesce(ok, F.lit(False)).alias("agrees"))


def class_mean_spectra(spectra: DataFrame) -> DataFrame:
    """(class_index, class_mean ARRAY<DOUBLE>)."""
    long = explode_spectra(spectra.select("class_index", "spectrum"))
    means = long.groupBy("class_index", "band").agg(F.avg("intensity").alias("intensity"))
    return collect_spectra(means, ["class_index"]).withColumnRenamed("spectrum", "class_mean")


def cosine_to_class(spectra: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """Add cosine similarity of each spectrum to its class mean."""
    means = class_mean_spectra(spectra) if means is None else means
    return spectra.join(means, "class_index").withColumn("cosine", A.cosine(F.col("spectrum"), F.col("class_mean"))).drop(
        "class_mean"
    )
