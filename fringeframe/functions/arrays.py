"""Numeric expressions over ARRAY<DOUBLE> columns.

One row holds one spectrum or one image, so per-sample work needs no shuffle.
`let` binds a value once inside a lambda; without it the optimizer may inline an
aggregate into an element lambda and evaluate it once per element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def mean(a: Column) -> Column:
    return let(a, lambda v: total(v) / F.nullif(F.size(v), F.lit(0)))


def sd_pop(a: Column) -> Column:
    """Population standard deviation, two-pass."""
    return let(
        F.struct(a.alias("a"), mean(a).alias("m")),
        lambda s: F.sqrt(
            F.aggregate(s["a"], F.lit(0.0), lambda t, v: t + (v - s["m"]) * (v - s["m"]))
            / F.nullif(F.size(s["a"]), F.lit(0))
        ),
    )


def finite(v: Column) -> Column:
    """True for a non-NULL value that is neither NaN nor infinite."""
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def zero_nonfinite(a: Column) -> Column:
    return F.transform(a, lambda v: F.when(finite(v), v).otherwise(F.lit(0.0)))


def at(a: Column, zero_based: Column) -> Column:
    """Element by zero-based position; NULL outside the array."""
    return F.get(a, zero_based.cast("int"))


def at_clamped(a: Column, zero_based: Column) -> Column:
    return at(a, F.greatest(F.lit(0), F.least(zero_based.cast("int"), F.size(a) - 1)))


def interpolate_at(a: Column, position: Column) -> Column:
    """Linear interpolation at a fractional zero-based position, clamped at both ends."""
    return let(
        F.greatest(F.lit(0.0), F.least(position, (F.size(a) - 1).cast("double"))),
        lambda p: at(a, F.floor(p)) * (F.lit(1.0) - (p - F.floor(p)))
        + at_clamped(a, F.floor(p) + 1) * (p - F.floor(p)),
    )


def percentile_sorted(ordered: Column, p: float) -> Column:
    """Linear-interpolation percentile (p in 0..1) of an already sorted array."""
    return interpolate_at(ordered, F.lit(float(p)) * (F.size(ordered) - 1))


def percentile(a: Column, p: float) -> Column:
    return let(F.array_sort(a), lambda s: percentile_sorted(s, p))


def linspace_rounded(count: int, picks: int) -> list[int]:
    """Distinct half-even rounded positions of `picks` even steps over 0..count-1."""
    if picks <= 1 or picks >= count:
        return list(range(count))
    return sorted({round(i * (count - 1) / (picks - 1)) for i in range(picks)})


def snv(a: Column, eps: float = 1e-6) -> Column:
    """Standard normal variate: centre and divide by population SD plus eps."""
    return let(
        F.struct(a.alias("a"), mean(a).alias("m"), sd_pop(a).alias("s")),
        lambda t: F.transform(t["a"], lambda v: (v - t["m"]) / (t["s"] + F.lit(eps))),
    )


def minmax(a: Column) -> Column:
    """Scale to 0..1 after turning NaN and infinities into 0; a constant array becomes zeros."""
    return let(
        zero_nonfinite(a),
        lambda z: let(
            F.struct(z.alias("a"), F.array_min(z).alias("lo"), F.array_max(z).alias("hi")),
            lambda t: F.transform(
                t["a"],
                lambda v: F.when(t["hi"] > t["lo"], (v - t["lo"]) / (t["hi"] - t["lo"])).otherwise(F.lit(0.0)),
            ),
        ),
    )


def moving_average(a: Column, width: int = 7) -> Column:
    """Centred mean over `width` neighbours with edge values repeated."""
    if width <= 1:
        return a
    half = width // 2
    return let(
        a,
        lambda s: F.transform(
            s,
            lambda _v, i: sum((at_clamped(s, i + k) for k in range(-half, half + 1)), F.lit(0.0)) / F.lit(float(width)),
        ),
    )


def gradient(a: Column) -> Column:
    """Central differences, one-sided at both ends."""
    return let(
        a,
        lambda s: F.transform(
            s,
            lambda v, i: F.when(i == 0, at(s, i + 1) - v)
            .when(i == F.size(s) - 1, v - at(s, i - 1))
            .otherwise((at(s, i + 1) - at(s, i - 1)) / 2.0),
        ),
    )


def zscore(a: Column) -> Column:
    """NULL-aware z-score; zero spread leaves the centred values."""
    return let(
        F.filter(a, lambda v: v.isNotNull()),
        lambda kept: let(
            F.struct(mean(kept).alias("m"), sd_pop(kept).alias("s")),
            lambda t: F.transform(
                a, lambda v: F.when(t["s"] > 0, (v - t["m"]) / t["s"]).otherwise(v - t["m"])
            ),
        ),
    )


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column, guard: float = 1e-12) -> Column:
    return let(
        F.struct(dot(a, b).alias("ab"), F.sqrt(dot(a, a)).alias("na"), F.sqrt(dot(b, b)).alias("nb")),
        lambda t: F.when(t["na"] * t["nb"] <= guard, F.lit(0.0)).otherwise(t["ab"] / (t["na"] * t["nb"])),
    )
