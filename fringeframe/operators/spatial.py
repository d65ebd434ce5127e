"""Image, radial and feature operators.

Images are `cube_id, class_index, band, height, width, pixels ARRAY<DOUBLE>` (row-major), one row per
(cube, band). Per-image work is an expression on one row; sums over pixels explode and aggregate in
the same stage, so only bins or bands are shuffled, never pixels.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fringeframe.functions import arrays as A
from fringeframe.functions.draws import draw_index, normal, uniform
from fringeframe.operators.quantiles import quantiles
from fringeframe.operators.skew import group_rank
from fringeframe.operators.spectral import nonzero_mean

IMAGE_KEYS = ["cube_id", "class_index", "band"]


def explode_pixels(images: DataFrame, value: str = "pixels", name: str = "intensity") -> DataFrame:
    """One row per pixel with y and x."""
    rows = images.select(*[c for c in images.columns if c != value], F.posexplode(value).alias("_i", name))
    return rows.withColumn("y", F.floor(F.col("_i") / F.col("width"))).withColumn("x", F.col("_i") % F.col("width")).drop("_i")


def radius(y: Column, x: Column, height: Column, width: Column) -> Column:
    dy, dx = y - (height - 1) / 2.0, x - (width - 1) / 2.0
    return F.sqrt(dy * dy + dx * dx)


def radial_bin(y: Column, x: Column, height: Column, width: Column, bins: int) -> Column:
    """Bin of a pixel's distance from the image centre, 0..bins-1."""
    corner = radius(F.lit(0.0), F.lit(0.0), height, width) + 1e-6
    raw = F.floor(radius(y, x, height, width) / corner * bins)
    return F.greatest(F.lit(0), F.least(raw, F.lit(bins - 1))).cast("bigint")


def radial_bins(images: DataFrame, bins: int) -> DataFrame:
    """(height, width, bin, pixels, center_px) for every image size; an empty bin counts one pixel."""
    sizes = images.select("height", "width").distinct()
    grid = sizes.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn(
        "x", F.explode(F.sequence(F.lit(0), F.col("width") - 1))
    )
    counted = (
        grid.withColumn("bin", radial_bin(F.col("y"), F.col("x"), F.col("height"), F.col("width"), bins))
        .groupBy("height", "width", "bin")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    numbers = F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))
    every = sizes.withColumn("bin", F.explode(numbers))
    corner = radius(F.lit(0.0), F.lit(0.0), F.col("height"), F.col("width")) + 1e-6
    return every.join(counted, ["height", "width", "bin"], "left").select(
        "height",
        "width",
        "bin",
        F.coalesce("_n", F.lit(1)).alias("pixels"),
        ((F.col("bin") + 0.5) * corner / bins).alias("center_px"),
    )


def radial_profile(images: DataFrame, bins: int, normalise: bool, keys: list[str] | None = None) -> DataFrame:
    """(keys..., profile ARRAY of `bins` means); optionally divided by its largest magnitude."""
    keys = keys or IMAGE_KEYS
    pixels = explode_pixels(images)
    means = (
        pixels.withColumn("_b", radial_bin(F.col("y"), F.col("x"), F.col("height"), F.col("width"), bins))
        .groupBy(*keys, "_b")
        .agg(F.avg("intensity").alias("_m"))
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("_b", "_m"))).alias("_map"))
    )
    filled = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint")),
        lambda b: F.coalesce(F.element_at("_map", b), F.lit(0.0)),
    )
    out = means.select(*keys, filled.alias("profile"))
    if not normalise:
        return out
    return out.withColumn("profile", peak_normalised(F.col("profile")))


def peak_normalised(profile: Column) -> Column:
    return A.let(
        F.struct(profile.alias("p"), F.array_max(F.transform(profile, lambda v: F.abs(v))).alias("m")),
        lambda t: F.transform(t["p"], lambda v: F.when(t["m"] > 0, v / t["m"]).otherwise(v)),
    )


def _pick(images: DataFrame, height, width, index, **columns: Column) -> DataFrame:
    """New images whose pixel i comes from zero-based position index(i) (NULL or outside: 0)."""
    pixels = A.let(
        F.struct(F.col("pixels").alias("p"), F.col("height").alias("h"), F.col("width").alias("w"),
                 *[c.alias(n) for n, c in columns.items()]),
        lambda s: F.transform(
            F.sequence(F.lit(0), F.lit(height) * F.lit(width) - 1),
            lambda i: F.coalesce(A.at(s["p"], index(s, i)), F.lit(0.0)),
        ),
    )
    return images.withColumn("pixels", pixels).withColumn("height", F.lit(height)).withColumn("width", F.lit(width))


def fit_template(images: DataFrame, height: int, width: int) -> DataFrame:
    """Center crop or zero pad to the template size, offsets rounded down."""

    def index(s: Column, i: Column) -> Column:
        y = F.floor(i / width) + F.greatest(F.floor((s["h"] - height) / 2), F.lit(0)) - F.greatest(F.floor((F.lit(height) - s["h"]) / 2), F.lit(0))
        x = i % width + F.greatest(F.floor((s["w"] - width) / 2), F.lit(0)) - F.greatest(F.floor((F.lit(width) - s["w"]) / 2), F.lit(0))
        inside = (y >= 0) & (y < s["h"]) & (x >= 0) & (x < s["w"])
        return F.when(inside, y * s["w"] + x)

    return _pick(images, height, width, index)


def tiles(frames: DataFrame, side: int) -> DataFrame:
    """Frames cut into tiles of at most side x side pixels: adds tile_y and tile_x, replaces pixels."""
    pieces = lambda length: F.ceil(F.col(length) / F.lit(side)).cast("int") - 1
    cut = frames.withColumn("tile_y", F.explode(F.sequence(F.lit(0), pieces("height")))).withColumn(
        "tile_x", F.explode(F.sequence(F.lit(0), pieces("width")))
    )
    pixels = A.let(
        F.struct(F.col("pixels").alias("p"), F.col("width").alias("w"), (F.col("tile_x") * side).alias("x")),
        lambda t: F.flatten(
            F.transform(
                F.sequence(F.col("tile_y") * side, F.least((F.col("tile_y") + 1) * side, F.col("height")) - 1),
                lambda y: F.slice(t["p"], (y * t["w"] + t["x"] + 1).cast("int"), F.least(F.lit(side), t["w"] - t["x"]).cast("int")),
            )
        ),
    )
    return cut.withColumn("pixels", pixels)


def crop_rois(frames: DataFrame, detections: DataFrame, scan: str, size: int, circular: bool, tile: int = 256) -> DataFrame:
    """One image per (detection, frame): window [c-half, c-half+size) with an optional circular mask.

    The mask keeps (y-half)^2 + (x-half)^2 <= half^2. A window outside the frame fails the job.

    Frames are cut into tiles, a detection goes to the tiles that its window touches (at most four while the window is no larger
    than a tile), and the crop is put together from their parts: no row holds a frame and a detection. The columns
    of `frames` other than pixels tell frames apart.
    """
    half = size // 2
    shape = frames.groupBy(scan).agg(F.min("height").alias("_h"), F.min("width").alias("_w"))
    x, y = F.col("x").cast("bigint"), F.col("y").cast("bigint")
    inside = (F.col("x") - half >= 0) & (F.col("y") - half >= 0) & (F.col("x") + (size - half) <= F.col("_w")) & (F.col("y") + (size - half) <= F.col("_h"))
    placed = detections.select(scan, "det_id", "x", "y").join(shape, scan).select(
        scan,
        "det_id",
        F.when(inside, x).otherwise(F.raise_error(F.lit("crop outside the frame"))).alias("_cx"),
        y.alias("_cy"),
    )
    first = lambda c: F.floor((c - half) / tile).cast("int")
    last = lambda c: F.floor((c + (size - half) - 1) / tile).cast("int")
    placed = placed.withColumn("_ty", first(F.col("_cy"))).withColumn("_tx", first(F.col("_cx"))).withColumn("_nx", last(F.col("_cx")) - F.col("_tx") + 1)
    touched = placed.withColumn("tile_y", F.explode(F.sequence(F.col("_ty"), last(F.col("_cy"))))).withColumn(
        "tile_x", F.explode(F.sequence(F.col("_tx"), last(F.col("_cx"))))
    )
    joined = tiles(frames, tile).join(touched, [scan, "tile_y", "tile_x"])
    top, left = F.col("tile_y") * tile, F.col("tile_x") * tile
    y0, x0 = F.greatest(F.col("_cy") - half, top), F.greatest(F.col("_cx") - half, left)
    y1, x1 = F.least(F.col("_cy") - half + size, top + tile), F.least(F.col("_cx") - half + size, left + tile)
    across = F.least(F.lit(tile), F.col("width") - left)
    part = A.let(
        F.struct(F.col("pixels").alias("p"), across.alias("w"), (x0 - left).alias("x"), (x1 - x0).cast("int").alias("n")),
        lambda t: F.flatten(F.transform(F.sequence(y0 - top, y1 - top - 1), lambda row: F.slice(t["p"], (row * t["w"] + t["x"] + 1).cast("int"), t["n"]))),
    )
    own = [c for c in frames.columns if c != "pixels"]
    parts = joined.select(*own, "det_id", "_cy", "_cx", "_ty", "_tx", "_nx", F.struct("tile_y", "tile_x", y0.alias("y"), x0.alias("x"), (x1 - x0).alias("n"), part.alias("p")).alias("_part"))
    whole = parts.groupBy(*own, "det_id", "_cy", "_cx", "_ty", "_tx", "_nx").agg(F.sort_array(F.collect_list("_part")).alias("_parts"))

    def pixel(s: Column, i: Column) -> Column:
        row, col = F.floor(i / size), i % size
        gy, gx = s["cy"] - half + row, s["cx"] - half + col
        at = (F.floor(gy / tile) - s["ty"]) * s["nx"] + F.floor(gx / tile) - s["tx"]
        value = A.let(A.at(s["parts"], at), lambda q: A.at(q["p"], (gy - q["y"]) * q["n"] + gx - q["x"]))
        if not circular:
            return value
        return F.when((row - half) * (row - half) + (col - half) * (col - half) <= half * half, value)

    pixels = A.let(
        F.struct(F.col("_parts").alias("parts"), *[F.col(f"_{c}").alias(c) for c in ("cy", "cx", "ty", "tx", "nx")]),
        lambda s: F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.coalesce(pixel(s, i), F.lit(0.0))),
    )
    return whole.withColumn("pixels", pixels).withColumn("height", F.lit(size)).withColumn("width", F.lit(size)).select(*own, "pixels", "det_id")


def resize_nearest(images: DataFrame, height: int, width: int, size: int) -> DataFrame:
    """Nearest-neighbour grid of `size` even, half-even rounded rows and columns."""
    pick = lambda n: [round(i * (n - 1) / (size - 1)) if size > 1 else 0 for i in range(size)]
    positions = F.array(*[F.lit(y * width + x) for y in pick(height) for x in pick(width)])
    pixels = A.let(F.col("pixels"), lambda p: F.transform(positions, lambda i: A.at(p, i)))
    return images.withColumn("pixels", pixels).withColumn("height", F.lit(size)).withColumn("width", F.lit(size))


def robust_stretch(pixels: Column, low: float = 1.0, high: float = 99.0, as_byte: bool = False) -> Column:
    """Clip to percentiles and scale to 0..1 (or truncated 0..255); falls back to min/max, then zeros."""

    def scale(t: Column) -> Column:
        flat = t["hi"] <= t["lo"]
        lo = F.when(flat, t["mn"]).otherwise(t["lo"])
        hi = F.when(flat, t["mx"]).otherwise(t["hi"])
        return A.let(
            F.struct(lo.alias("lo"), hi.alias("hi"), t["p"].alias("p")),
            lambda b: F.transform(
                b["p"],
                lambda v: F.when(b["hi"] <= b["lo"], F.lit(0.0)).otherwise(
                    _byte(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - b["lo"]) / (b["hi"] - b["lo"]))), as_byte)
                ),
            ),
        )

    return A.let(
        F.struct(pixels.alias("p"), F.array_sort(pixels).alias("s")),
        lambda t: A.let(
            F.struct(
                t["p"].alias("p"),
                A.percentile_sorted(t["s"], low / 100.0).alias("lo"),
                A.percentile_sorted(t["s"], high / 100.0).alias("hi"),
                F.array_min(t["p"]).alias("mn"),
                F.array_max(t["p"]).alias("mx"),
            ),
            scale,
        ),
    )


def _byte(v: Column, wanted: bool) -> Column:
    return F.floor(v * 255.0).cast("double") if wanted else v


def fit_normaliser(images: DataFrame, low: float = 0.5, high: float = 99.5) -> DataFrame:
    """One row (low, high): exact percentiles of all pixel values, fitted on the rows given (use training rows)."""
    return _value_range(images, F.col("pixels"), low, high)


def fit_normaliser_drawn(images: DataFrame, per_image: int, low: float = 0.5, high: float = 99.5, seed: int = 2026) -> DataFrame:
    """`fit_normaliser` of `per_image` values of every image, drawn with replacement by hash, whatever the images' size."""
    draws = A.let(
        F.struct(F.col("pixels").alias("p"), F.col("cube_id").alias("c"), F.col("band").alias("b")),
        lambda s: F.transform(
            F.sequence(F.lit(1), F.lit(per_image)),
            lambda k: A.at(s["p"], draw_index(F.size(s["p"]), seed, s["c"], s["b"], k)),
        ),
    )
    return _value_range(images, draws, low, high)


def _value_range(images: DataFrame, values: Column, low: float, high: float) -> DataFrame:
    ends = quantiles(images, [], values, {"_lo": low / 100.0, "_hi": high / 100.0, "_mn": 0.0, "_mx": 1.0})
    flat = ~(A.finite(F.col("_lo")) & A.finite(F.col("_hi"))) | (F.col("_hi") <= F.col("_lo"))
    lo = F.when(flat, F.col("_mn")).otherwise(F.col("_lo"))
    hi = F.when(flat, F.col("_mx")).otherwise(F.col("_hi"))
    return ends.select(lo.alias("low"), F.when(hi <= lo, lo + 1.0).otherwise(hi).alias("high"))


def _range(normaliser: DataFrame) -> Column:
    return normaliser.select(F.struct("low", "high")).scalar()


def normalise(images: DataFrame, normaliser: DataFrame) -> DataFrame:
    """Scale pixels into 0..1 with clipping."""
    return (
        images.withColumn("_r", _range(normaliser))
        .withColumn(
            "pixels",
            A.let(
                F.struct(F.col("_r.low").alias("lo"), F.greatest(F.col("_r.high") - F.col("_r.low"), F.lit(1e-6)).alias("s"), F.col("pixels").alias("p")),
                lambda t: F.transform(t["p"], lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - t["lo"]) / t["s"]))),
            ),
        )
        .drop("_r")
    )


def denormalise(images: DataFrame, normaliser: DataFrame) -> DataFrame:
    """Back to raw values; non-finite becomes the low end, negatives 0."""
    return (
        images.withColumn("_r", _range(normaliser))
        .withColumn(
            "pixels",
            A.let(
                F.struct(F.col("_r.low").alias("lo"), F.greatest(F.col("_r.high") - F.col("_r.low"), F.lit(1e-6)).alias("s"), F.col("pixels").alias("p")),
                lambda t: F.transform(
                    t["p"],
                    lambda v: F.greatest(F.lit(0.0), F.when(A.finite(v), v * t["s"] + t["lo"]).otherwise(t["lo"])),
                ),
            ),
        )
        .drop("_r")
    )


def gradient_magnitude(pixels: Column, height: Column, width: Column) -> Column:
    """hypot of central differences in y and x (one-sided at borders)."""

    def slope(p: Column, i: Column, position: Column, count: Column, stride: Column) -> Column:
        ahead, behind = A.at(p, i + stride), A.at(p, i - stride)
        here = A.at(p, i)
        return (
            F.when(position == 0, ahead - here)
            .when(position == count - 1, here - behind)
            .otherwise((ahead - behind) / 2.0)
        )

    return A.let(
        F.struct(pixels.alias("p"), height.alias("h"), width.alias("w")),
        lambda s: F.transform(
            s["p"],
            lambda _v, i: F.hypot(
                slope(s["p"], i, F.floor(i / s["w"]), s["h"], s["w"]), slope(s["p"], i, i % s["w"], s["w"], F.lit(1))
            ),
        ),
    )


def mean_image(images: DataFrame, bands: list[int], keys: list[str]) -> DataFrame:
    """Pixel-wise mean over the listed bands; at most len(bands) images meet in one group."""
    packed = images.filter(F.col("band").isin(bands)).groupBy(*keys, "height", "width").agg(
        F.collect_list("pixels").alias("_l")
    )
    mean = A.let(
        F.col("_l"),
        lambda l: F.transform(l[0], lambda _v, i: F.aggregate(l, F.lit(0.0), lambda s, p: s + A.at(p, i)) / F.size(l)),
    )
    return packed.withColumn("pixels", mean).drop("_l")


def pseudo_channels(images: DataFrame, best_band: int, bands: int, context: int = 24) -> DataFrame:
    """Three-channel feature image per cube: best band, context mean, gradient of the context mean."""
    keys = ["cube_id", "class_index"]
    single = images.filter(F.col("band") == best_band).select(*keys, robust_stretch(F.col("pixels")).alias("channel_1"))
    mean = mean_image(images, A.linspace_rounded(bands, context), keys)
    stretched = mean.withColumn("channel_2", robust_stretch(F.col("pixels"))).drop("pixels")
    third = robust_stretch(gradient_magnitude(F.col("channel_2"), F.col("height"), F.col("width")))
    return stretched.join(single, keys).withColumn("channel_3", third)


def _leading_vector(keys: list[str]):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        bands = sorted(set(pdf["band_i"]) | set(pdf["band_j"]))
        at = {b: k for k, b in enumerate(bands)}
        gram = np.zeros((len(bands), len(bands)))
        for i, j, g in zip(pdf["band_i"], pdf["band_j"], pdf["g"]):
            gram[at[i], at[j]] = gram[at[j], at[i]] = g
        values, vectors = np.linalg.eigh(gram)
        w = vectors[:, int(np.argmax(values))]
        w = -w if w.sum() < 0 else w
        first = pdf.iloc[0]
        return pd.DataFrame({**{k: first[k] for k in keys}, "band": bands, "weight": w})

    return solve


def pca_weights(images: DataFrame, max_bands: int = 24, keys: list[str] | None = None) -> DataFrame:
    """(keys..., band, weight, mean, sd): first principal component over at most `max_bands` bands per cube.

    The band-pair products are row expressions on a self-join of <= max_bands rows per cube; only the
    small Gram matrix of each cube reaches a grouped kernel.
    """
    keys = keys or ["cube_id"]
    stats = images.select(
        *keys, "band", "pixels", A.mean(F.col("pixels")).alias("mean"), (A.sd_pop(F.col("pixels")) + 1e-6).alias("sd")
    )
    counted = stats.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    few = F.when(F.col("_n") > max_bands, F.raise_error(F.lit("too many bands for a pairwise component"))).otherwise(True)
    standard = stats.join(counted, keys).filter(few).select(
        *keys,
        "band",
        A.let(
            F.struct("pixels", "mean", "sd"),
            lambda t: F.transform(t["pixels"], lambda v: (v - t["mean"]) / t["sd"]),
        ).alias("z"),
    )
    left = standard.select(*keys, F.col("band").alias("band_i"), F.col("z").alias("zi"))
    right = standard.select(*keys, F.col("band").alias("band_j"), F.col("z").alias("zj"))
    gram = left.join(right, keys).filter("band_i <= band_j").select(
        *keys, "band_i", "band_j", (A.dot(F.col("zi"), F.col("zj")) / F.greatest(F.lit(1), F.size("zi") - 1)).alias("g")
    )
    kinds = {f.name: f.dataType.simpleString() for f in images.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", band {kinds['band']}, weight double"
    weights = gram.groupBy(*keys).applyInPandas(_leading_vector(keys), schema)
    return weights.join(stats.drop("pixels"), [*keys, "band"])


def pca_first_component(images: DataFrame, max_bands: int = 24, keys: list[str] | None = None) -> DataFrame:
    """(keys..., height, width, pixels): projection of the z-scored bands on the first component."""
    keys = keys or ["cube_id"]
    weighted = images.join(pca_weights(images, max_bands, keys), [*keys, "band"]).select(
        *keys,
        "height",
        "width",
        A.let(
            F.struct("pixels", "weight", "mean", "sd"),
            lambda t: F.transform(t["pixels"], lambda v: t["weight"] * (v - t["mean"]) / t["sd"]),
        ).alias("z"),
    )
    packed = weighted.groupBy(*keys, "height", "width").agg(F.collect_list("z").alias("_l"))
    total = A.let(
        F.col("_l"),
        lambda l: F.transform(l[0], lambda _v, i: F.aggregate(l, F.lit(0.0), lambda s, p: s + A.at(p, i))),
    )
    return packed.withColumn("pixels", total).drop("_l")


def image_stats(images: DataFrame) -> DataFrame:
    """Per image: mean, population SD, p10, p90 and the center pixel."""
    p = F.col("pixels")
    center = F.floor(F.col("height") / 2) * F.col("width") + F.floor(F.col("width") / 2)
    return images.select(
        *IMAGE_KEYS,
        A.mean(p).alias("mean"),
        A.sd_pop(p).alias("sd"),
        A.percentile(p, 0.1).alias("p10"),
        A.percentile(p, 0.9).alias("p90"),
        A.at(p, center).alias("center"),
    )


def cube_stats(images: DataFrame) -> DataFrame:
    """Per cube: mean and population SD over all pixels from per-image sums, variance floored at 0."""
    p = F.col("pixels")
    sums = images.select(
        "cube_id", "class_index", F.size(p).cast("double").alias("_n"), A.total(p).alias("_s"), A.dot(p, p).alias("_q")
    )
    total = sums.groupBy("cube_id", "class_index").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"), F.sum("_q").alias("_q"))
    mean = F.col("_s") / F.col("_n")
    return total.select(
        "cube_id",
        "class_index",
        mean.alias("cube_mean"),
        F.sqrt(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0))).alias("cube_sd"),
    )


VARIANTS = ("spectral", "spectral_radial", "spectral_radial_stats")


def features(images: DataFrame, bands: list[int], bins: int, variant: str = "spectral_radial_stats") -> DataFrame:
    """(cube_id, class_index, features): SNV of the selected bands, their radial profiles, six globals.

    A feature's place depends on the order of `bands` alone. The places of a band that a cube lacks are NULL, the SNV is over the others.
    """
    if variant not in VARIANTS:
        raise ValueError(variant)
    keys = ["cube_id", "class_index"]
    pixels = F.col("pixels")
    per_band = images.select(*keys, "band", nonzero_mean(pixels).alias("intensity"))
    packed = F.sort_array(F.collect_list(F.struct(F.col("band").alias("at"), F.col("intensity").alias("v"))))
    spectra = per_band.groupBy(*keys).agg(packed.alias("_s"))
    out = spectra.withColumn("features", _snv_of_present(_placed(F.col("_s"), bands, F.lit(None).cast("double"))))
    if variant != "spectral":
        profiles = radial_profile(images.filter(F.col("band").isin(bands)), bins, True)
        stacked = profiles.groupBy(*keys).agg(F.collect_list(F.struct(F.col("band").alias("at"), F.col("profile").alias("v"))).alias("_p"))
        out = out.join(stacked, keys, "left").withColumn("features", F.concat("features", _flat_profiles(F.col("_p"), bands, bins))).drop("_p")
    if variant == "spectral_radial_stats":
        s = F.transform("_s", lambda b: b["v"])
        globals_ = F.array(
            A.mean(s), A.sd_pop(s), A.percentile(s, 0.1), A.percentile(s, 0.9), F.col("cube_mean"), F.col("cube_sd")
        )
        out = out.join(cube_stats(images), keys).withColumn("features", F.concat("features", globals_))
    return out.select(*keys, "features")


def _placed(found: Column, places: list[int], missing: Column) -> Column:
    """Values of (at, v) structs in the order of `places`; `missing` where a place has none."""
    return A.let(
        F.coalesce(found, F.array()),
        lambda f: F.transform(
            F.array(*[F.lit(p) for p in places]), lambda p: F.coalesce(A.at(F.filter(f, lambda s: s["at"] == p), F.lit(0))["v"], missing)
        ),
    )


def _flat_profiles(found: Column, places: list[int], bins: int) -> Column:
    return F.flatten(_placed(found, places, F.array_repeat(F.lit(None).cast("double"), bins)))


def _snv_of_present(a: Column) -> Column:
    """SNV over the values that are there; a NULL stays NULL."""
    return A.let(
        F.struct(a.alias("a"), F.filter(a, lambda v: v.isNotNull()).alias("p")),
        lambda t: A.let(
            F.struct(t["a"].alias("a"), A.mean(t["p"]).alias("m"), A.sd_pop(t["p"]).alias("s")),
            lambda u: F.transform(u["a"], lambda v: (v - u["m"]) / (u["s"] + F.lit(1e-6))),
        ),
    )


def features_selected_only(
    images: DataFrame, wavelengths: list[float], axis: tuple[float, float, int], bins: int
) -> DataFrame:
    """(cube_id, class_index, features): SNV and radial profiles at selected wavelengths only.

    Only the frames next to a selected wavelength are read (the band filter reaches the scan); frames
    between two bands are interpolated. `axis` is (first nm, last nm, bands). A wavelength for which a cube lacks one of the frames
    leaves its places NULL, the SNV is over the others.
    """
    lo, hi, count = axis
    keys = ["cube_id", "class_index"]
    plan = []
    for order, nm in enumerate(wavelengths):
        position = min(max((nm - lo) / (hi - lo) * (count - 1), 0.0), count - 1.0)
        low, high = math.floor(position), math.ceil(position)
        plan.append((order, low, high, position - low))
    needed = sorted({b for _o, low, high, _w in plan for b in (low, high)})
    roles = F.array(
        *[
            F.struct(
                F.lit(o).alias("order"), F.lit(b).alias("need"), F.lit(role).alias("role"), F.lit(float(w)).alias("w")
            )
            for o, low, high, w in plan
            for role, b in (("lo", low), ("hi", high))
        ]
    )
    used = images.filter(F.col("band").isin(needed))
    paired = used.select("*", F.explode(F.filter(roles, lambda r: r["need"] == F.col("band"))).alias("r"))
    mixed = paired.groupBy(*keys, "height", "width", F.col("r.order").alias("order"), F.col("r.w").alias("w")).agg(
        F.max(F.when(F.col("r.role") == "lo", F.col("pixels"))).alias("a"),
        F.max(F.when(F.col("r.role") == "hi", F.col("pixels"))).alias("b"),
    )
    pixels = A.let(
        F.struct("a", "b", "w"),
        lambda t: F.zip_with(t["a"], t["b"], lambda p, q: p * (1.0 - t["w"]) + q * t["w"]),
    )
    whole = mixed.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    crops = whole.select(*keys, F.col("order").alias("band"), "height", "width", pixels.alias("pixels"))
    profiles = radial_profile(crops, bins, True)
    spectrum = crops.select(*keys, "band", nonzero_mean(F.col("pixels")).alias("intensity"))
    joined = spectrum.join(profiles, [*keys, "band"]).groupBy(*keys).agg(
        F.collect_list(F.struct(F.col("band").alias("at"), F.col("intensity").alias("v"))).alias("_s"),
        F.collect_list(F.struct(F.col("band").alias("at"), F.col("profile").alias("v"))).alias("_p"),
    )
    orders = list(range(len(wavelengths)))
    snv = _snv_of_present(_placed(F.col("_s"), orders, F.lit(None).cast("double")))
    return joined.select(*keys, F.concat(snv, _flat_profiles(F.col("_p"), orders, bins)).alias("features"))


def augment(
    images: DataFrame, per_class: int, seed: int, bands: int, gain_sd: float = 0.06, offset: float = 0.008, noise: float = 0.012
) -> DataFrame:
    """Classical augmentation: `per_class` new cubes per class, drawn with replacement from its cubes.

    Each is rotated by a multiple of 90 degrees, flipped, shifted by up to two bands, scaled, offset,
    given pixel noise and clipped at 0. All draws are hashes of (seed, class, item), so a recomputed
    partition gives the same cubes. Offset and noise scale with max(SD, 1) of the scaled cube.
    """
    cubes = images.select("class_index", "cube_id").distinct()
    ranked = group_rank(cubes, ["class_index"], [F.col("cube_id")], F.col("cube_id"), "_rank").withColumn(
        "_pick", F.col("_rank") - 1
    )
    sizes = cubes.groupBy("class_index").agg(F.count(F.lit(1)).alias("_n"))
    c, item = F.col("class_index"), F.col("item")
    plans = (
        sizes.withColumn("item", F.explode(F.sequence(F.lit(1), F.lit(per_class))))
        .withColumn("_pick", draw_index(F.col("_n"), seed, c, item, "source"))
        .join(ranked, ["class_index", "_pick"])
        .select(
            "class_index",
            "item",
            "cube_id",
            draw_index(F.lit(4), seed, c, item, "turn").alias("turn"),
            (uniform(seed, c, item, "mirror") < 0.5).alias("mirror"),
            (uniform(seed, c, item, "flip") < 0.5).alias("flip"),
            (uniform(seed, c, item, "shift") * 4.0 - 2.0).alias("shift"),
            (normal(seed, c, item, "gain") * gain_sd + 1.0).alias("gain"),
            normal(seed, c, item, "offset").alias("offset"),
        )
    )
    source = F.greatest(F.lit(0.0), F.least(F.lit(float(bands - 1)), F.col("band") - F.col("shift")))
    wanted = (
        plans.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
        .withColumn("_src", source)
        .withColumn("_left", F.floor("_src"))
        .withColumn("_right", F.least(F.col("_left") + 1, F.lit(bands - 1)))
        .withColumn("_w", F.col("_src") - F.col("_left"))
    )
    pool = images.select("cube_id", F.col("band").alias("_b"), "height", "width", "pixels")
    near = lambda side, name: pool.select(
        "cube_id", F.col("_b").alias(side), *([] if name == "q" else ["height", "width"]), F.col("pixels").alias(name)
    )
    both = wanted.join(near("_left", "p"), ["cube_id", "_left"]).join(near("_right", "q"), ["cube_id", "_right"])
    turned = (F.col("turn") % 2) == 1
    out_h = F.when(turned, F.col("width")).otherwise(F.col("height"))
    out_w = F.when(turned, F.col("height")).otherwise(F.col("width"))

    def moved(t: Column) -> Column:
        def value(i: Column) -> Column:
            y0, x0 = F.floor(i / t["ow"]), i % t["ow"]
            y = F.when(t["flip"], t["oh"] - 1 - y0).otherwise(y0)
            x = F.when(t["mirror"], t["ow"] - 1 - x0).otherwise(x0)
            sy = (
                F.when(t["turn"] == 0, y).when(t["turn"] == 1, x).when(t["turn"] == 2, t["h"] - 1 - y).otherwise(t["h"] - 1 - x)
            )
            sx = (
                F.when(t["turn"] == 0, x).when(t["turn"] == 1, t["w"] - 1 - y).when(t["turn"] == 2, t["w"] - 1 - x).otherwise(y)
            )
            j = sy * t["w"] + sx
            return t["gain"] * (A.at(t["p"], j) * (1.0 - t["k"]) + A.at(t["q"], j) * t["k"])

        return F.transform(F.sequence(F.lit(0), F.size(t["p"]) - 1), value)

    shaped = both.select(
        "class_index",
        "item",
        "cube_id",
        F.col("band").cast("bigint").alias("band"),
        out_h.alias("height"),
        out_w.alias("width"),
        "offset",
        A.let(
            F.struct(
                "p", "q", F.col("_w").alias("k"), "gain", "turn", "flip", "mirror",
                F.col("height").alias("h"), F.col("width").alias("w"), out_h.alias("oh"), out_w.alias("ow"),
            ),
            moved,
        ).alias("pixels"),
    )
    p = F.col("pixels")
    spread = (
        shaped.select("class_index", "item", F.size(p).alias("n"), A.total(p).alias("s"), A.dot(p, p).alias("q"))
        .groupBy("class_index", "item")
        .agg(
            F.greatest(
                F.lit(1.0),
                F.sqrt(F.greatest(F.lit(0.0), F.sum("q") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), F.lit(2)))),
            ).alias("spread")
        )
    )
    joined = shaped.join(spread, ["class_index", "item"])
    base = F.col("offset") * F.lit(offset) * F.col("spread")
    if noise == 0:
        final = A.let(
            F.struct("pixels", base.alias("o")),
            lambda t: F.transform(t["pixels"], lambda v: F.greatest(F.lit(0.0), v + t["o"])),
        )
    else:
        final = A.let(
            F.struct(
                "pixels", base.alias("o"), (F.lit(noise) * F.col("spread")).alias("s"),
                F.xxhash64(F.lit(seed), c, item, "band").alias("h"),
            ),
            lambda t: F.transform(
                t["pixels"], lambda v, i: F.greatest(F.lit(0.0), v + t["o"] + t["s"] * _fast_normal(t["h"], i))
            ),
        )
    return joined.select("class_index", "item", "cube_id", "band", "height", "width", final.alias("pixels"))


def _fast_normal(base: Column, i: Column) -> Column:
    """Box-Muller from two 52-bit hash uniforms; cheaper than sha1 for every pixel."""
    u = lambda salt: (F.pmod(F.xxhash64(base, i, F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2.0 * F.log(u(1))) * F.cos(2.0 * math.pi * u(2))


def _spread(c: str) -> Column:
    return F.sqrt(F.greatest(F.var_pop(c), F.lit(1e-6)))


def physics_reference(images: DataFrame, bins: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per-class mean and SD (variance floor 1e-6) of spectrum, energy and radial profile of normalised images."""
    spectrum = images.select(*IMAGE_KEYS, A.mean(F.col("pixels")).alias("v"))
    by_band = spectrum.groupBy("class_index", "band").agg(F.avg("v").alias("mean"), _spread("v").alias("sd"))
    energy = cube_stats(images).groupBy("class_index").agg(F.avg("cube_mean").alias("mean"), _spread("cube_mean").alias("sd"))
    radial = (
        radial_profile(images, bins, False)
        .select(*IMAGE_KEYS, F.posexplode("profile").alias("bin", "v"))
        .groupBy("class_index", "band", "bin")
        .agg(F.avg("v").alias("mean"), _spread("v").alias("sd"))
    )
    return by_band, energy, radial


def radial_rescale(profile: Column, scale: Column) -> Column:
    """Resample a profile at positions j*scale, clamped to bins - 1.0001, linearly."""

    def value(t: Column, j: Column) -> Column:
        src = F.greatest(F.lit(0.0), F.least(j * t["s"], F.size(t["p"]) - F.lit(1.0001)))
        left = F.floor(src)
        return A.at(t["p"], left) * (1.0 - (src - left)) + A.at_clamped(t["p"], left + 1) * (src - left)

    return A.let(
        F.struct(profile.alias("p"), scale.alias("s")),
        lambda t: F.transform(t["p"], lambda _v, j: value(t, j.cast("double"))),
    )


# Archived score weights and tolerances.
PHYSICS_WEIGHTS = {
    "range_score": 0.05,
    "spectral_smooth": 0.08,
    "spatial_tv": 0.02,
    "energy": 0.04,
    "class_spectrum": 0.04,
    "radial_reference": 0.03,
    "fresnel_scaling": 0.08,
}
SPECTRUM_TOLERANCE, RADIAL_TOLERANCE = 2.5, 3.0


def _mean_square_curvature(a: Column, b: Column, c: Column) -> Column:
    """Mean of (a - 2b + c)^2 over positions; NULL when a neighbour is missing."""
    bends = F.zip_with(F.zip_with(a, c, lambda x, y: x + y), b, lambda s, m: (s - 2.0 * m) * (s - 2.0 * m))
    return F.when(a.isNotNull() & c.isNotNull(), A.mean(bends))


def physics_scores(
    images: DataFrame, wavelengths: list[float], bins: int, reference: tuple[DataFrame, DataFrame, DataFrame] | None = None
) -> DataFrame:
    """Per cube: seven physical plausibility scores of normalised images and their weighted total.

    Bands of one cube meet in one window (bounded by the axis), one image per row.
    """
    by_band, energy, radial = physics_reference(images, bins) if reference is None else reference
    keys = ["cube_id", "class_index"]
    p, h, w = F.col("pixels"), F.col("height"), F.col("width")
    along = Window.partitionBy(*keys).orderBy("band")

    def steps(t: Column, stride: Column, last: Column) -> Column:
        return F.aggregate(
            F.transform(
                t["p"],
                lambda v, i: F.when(last(i), F.lit(0.0)).otherwise(F.pow(A.at(t["p"], i + stride) - v, F.lit(2))),
            ),
            F.lit(0.0),
            lambda s, v: s + v,
        )

    shape = F.struct(p.alias("p"), h.alias("h"), w.alias("w"))
    tv_x = A.let(shape, lambda t: steps(t, F.lit(1), lambda i: i % t["w"] == t["w"] - 1) / (t["h"] * (t["w"] - 1)))
    tv_y = A.let(shape, lambda t: steps(t, t["w"], lambda i: F.floor(i / t["w"]) == t["h"] - 1) / ((t["h"] - 1) * t["w"]))
    over = lambda f: A.mean(F.transform(p, lambda v: F.pow(F.greatest(F.lit(0.0), f(v)), F.lit(2))))
    per_image = (
        images.withColumn("_before", F.lag("pixels", 1).over(along))
        .withColumn("_after", F.lead("pixels", 1).over(along))
        .select(
            *IMAGE_KEYS,
            (over(lambda v: -v) + over(lambda v: v - 1.0)).alias("rng"),
            _mean_square_curvature(F.col("_before"), p, F.col("_after")).alias("bend"),
            (tv_x + tv_y).alias("tv"),
            A.mean(p).alias("mean"),
        )
    )
    spectral = (
        per_image.join(by_band.select("class_index", "band", F.col("mean").alias("_m"), F.col("sd").alias("_s")), ["class_index", "band"])
        .groupBy(*keys)
        .agg(
            F.avg("rng").alias("range_score"),
            F.coalesce(F.avg("bend"), F.lit(0.0)).alias("spectral_smooth"),
            F.avg("tv").alias("spatial_tv"),
            F.avg(
                F.pow((F.col("mean") - F.col("_m")) / F.greatest(F.col("_s") * SPECTRUM_TOLERANCE, F.lit(0.03)), F.lit(2))
            ).alias("class_spectrum"),
        )
    )
    level = cube_stats(images).join(energy, "class_index").select(
        *keys,
        F.pow((F.col("cube_mean") - F.col("mean")) / F.greatest(F.col("sd") * SPECTRUM_TOLERANCE, F.lit(0.02)), F.lit(2)).alias("energy"),
    )
    profiles = radial_profile(images, bins, False)
    centre = sum(wavelengths) / len(wavelengths)
    scales = F.array(*[F.lit(math.sqrt(max(nm / centre, 1e-6))) for nm in wavelengths])
    ring = F.pow((F.col("v") - F.col("mean")) / F.greatest(F.col("sd") * RADIAL_TOLERANCE, F.lit(0.035)), F.lit(2))
    ringed = (
        profiles.select(*IMAGE_KEYS, F.posexplode("profile").alias("bin", "v"))
        .join(radial, ["class_index", "band", "bin"])
        .groupBy(*keys)
        .agg(F.avg(ring).alias("radial_reference"))
    )
    fresnel = (
        profiles.withColumn("_r", radial_rescale(F.col("profile"), scales[F.col("band").cast("int")]))
        .withColumn("_before", F.lag("_r", 1).over(along))
        .withColumn("_after", F.lead("_r", 1).over(along))
        .groupBy(*keys)
        .agg(
            F.coalesce(
                F.avg(_mean_square_curvature(F.col("_before"), F.col("_r"), F.col("_after"))), F.lit(0.0)
            ).alias("fresnel_scaling")
        )
    )
    out = spectral.join(level, keys).join(ringed, keys).join(fresnel, keys)
    total = sum((F.lit(weight) * F.col(name) for name, weight in PHYSICS_WEIGHTS.items()), F.lit(0.0))
    return out.withColumn("total", total)


def geometry_report(
    bands: DataFrame, width: int, height: int, pixel_um: float = 1.4, object_mm: float = 5.0, radii_um=(5.0, 25.0, 50.0)
) -> DataFrame:
    """One row: crop size, Fresnel length range (px) and Fresnel numbers at the mean wavelength."""
    metres = F.col("wavelength_nm") * 1e-9
    z = object_mm * 1e-3
    length = F.sqrt(metres * z) / (pixel_um * 1e-6)
    return bands.agg(
        F.lit(width * pixel_um).alias("crop_width_um"),
        F.lit(height * pixel_um).alias("crop_height_um"),
        F.min(length).alias("fresnel_length_px_min"),
        F.max(length).alias("fresnel_length_px_max"),
        *[
            (F.lit((r * 1e-6) ** 2) / (F.avg(metres) * z)).alias(f"fresnel_number_radius_{r:g}um") for r in radii_um
        ],
    )


def cube_manifest(images: DataFrame, normaliser: DataFrame) -> DataFrame:
    """Per cube: normalised mean and SD, cosine of its mean spectrum to the class mean, raw min and max.

    Bands meet by number: a cube that lacks some is compared over those it has.
    """
    keys = ["cube_id", "class_index"]
    scaled = normalise(images, normaliser)
    spectra = scaled.select(*keys, "band", A.mean(F.col("pixels")).alias("v"))
    means = spectra.groupBy("class_index", "band").agg(F.avg("v").alias("m"))
    product = lambda a, b: F.sum(F.col(a) * F.col(b))
    sums = spectra.join(means, ["class_index", "band"]).groupBy(*keys).agg(
        product("v", "m").alias("_vm"), F.sqrt(product("v", "v")).alias("_v"), F.sqrt(product("m", "m")).alias("_m")
    )
    length = F.col("_v") * F.col("_m")
    cosine = sums.select(*keys, F.when(length <= 1e-12, F.lit(0.0)).otherwise(F.col("_vm") / length).alias("cosine"))
    raw = images.groupBy(*keys).agg(
        F.min(F.array_min("pixels")).alias("min_raw"), F.max(F.array_max("pixels")).alias("max_raw")
    )
    return cube_stats(scaled).join(cosine, keys).join(raw, keys)


def ring_support(patches: DataFrame, box: int, key: str = "patch_id") -> DataFrame:
    """(key, support): ring evidence of a candidate center from its `energy` patch (box x box, row-major).

    Radial oscillation x angular balance x ring peak x min(annulus ratio, 2.5); 0 for incomplete patches.
    """
    half = box // 2
    inner, outer = max(7.0, box * 0.09), min(half - 7.0, box * 0.43)
    size = F.lit(box)
    pixels = patches.filter(F.size("energy") == box * box).select(key, F.posexplode("energy").alias("_i", "e"))
    y, x = F.floor(F.col("_i") / box), F.col("_i") % box
    r = radius(y, x, size, size)
    mid = (box - 1) / 2.0
    sector = F.floor((F.atan2(y - mid, x - mid) + math.pi) / (2.0 * math.pi / 24))
    annulus = r.between(inner, outer)
    ring = F.floor(r)
    roles = F.array(
        F.when(ring.between(math.ceil(inner), math.floor(outer)), F.struct(F.lit("ring").alias("kind"), ring.alias("k"))),
        F.when(annulus & (sector < 24), F.struct(F.lit("sector").alias("kind"), sector.alias("k"))),
        F.when(annulus, F.struct(F.lit("annulus").alias("kind"), F.lit(0).cast("bigint").alias("k"))),
        F.when(r.between(outer + 1.0, half - 2.0), F.struct(F.lit("rim").alias("kind"), F.lit(0).cast("bigint").alias("k"))),
    )
    means = (
        pixels.select(key, "e", F.explode(F.filter(roles, lambda s: s.isNotNull())).alias("s"))
        .groupBy(key, "s.kind", "s.k")
        .agg(F.avg("e").alias("m"))
    )
    pack = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("m")))
    packed = means.groupBy(key).agg(
        pack("ring").alias("profile"),
        pack("sector").alias("sectors"),
        F.max(F.when(F.col("kind") == "annulus", F.col("m"))).alias("annulus"),
        F.max(F.when(F.col("kind") == "rim", F.col("m"))).alias("rim"),
    )
    prof, sect = F.col("profile"), F.col("sectors")
    eps = 1e-6
    score = (
        (A.sd_pop(prof) / (A.mean(prof) + eps))
        * (A.percentile(sect, 0.25) / (A.percentile(sect, 0.75) + eps))
        * (A.percentile(prof, 0.9) / (A.percentile(prof, 0.35) + eps))
        * F.least(F.greatest(F.col("annulus") / (F.col("rim") + eps), F.lit(0.0)), F.lit(2.5))
    )
    usable = (F.size(prof) >= 5) & (F.size(sect) >= 8) & (A.mean(prof) > eps) & F.col("rim").isNotNull()
    scored = packed.select(key, F.when(usable & A.finite(score), F.greatest(score, F.lit(0.0))).alias("_s"))
    return patches.select(key).distinct().join(scored, key, "left").select(key, F.coalesce("_s", F.lit(0.0)).alias("support"))
