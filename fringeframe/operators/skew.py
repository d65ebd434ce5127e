"""Ranks, running totals and exact percentiles that stay parallel inside one hot key.

A plain window sorts a whole key in one task. One count per key (combined map-side) decides:
without a key of more than `hot_rows` rows the plain window is used; otherwise each such key is
cut into value ranges, sorted range by range, and shifted by the total of the ranges below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fringeframe.functions.arrays import let
from fringeframe.operators.settle import settled

HOT_ROWS = 200_000
# Value ranges of a hot key: RANGE_STEP**2, found by a search in two steps.
RANGE_STEP = 32
RANGES = RANGE_STEP * RANGE_STEP


def _range_of(cuts: Column, value: Column) -> Column:
    """Number of cuts below the value."""
    below = lambda a: F.size(F.filter(a, lambda c: c < value))
    coarse = F.transform(F.sequence(F.lit(RANGE_STEP - 1), F.lit(RANGES - 2), F.lit(RANGE_STEP)), lambda i: cuts[i])
    return let(
        below(coarse) * RANGE_STEP, lambda start: start + below(F.slice(cuts, start + 1, F.lit(RANGE_STEP - 1)))
    )


def running_total(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    range_by: Column,
    name: str,
    weight: Column | None = None,
    hot_rows: int = HOT_ROWS,
    how: str = "sum",
) -> DataFrame:
    """Add `name`: sum (or `how="max"`) of `weight` (1 when None) over rows up to this one within the key.

    `order` must be a strict ascending order whose first column never disagrees with
    `range_by`, a numeric expression of it.
    """
    combine = F.max if how == "max" else F.sum
    amount = F.lit(1).cast("bigint") if weight is None else weight

    def ordered(*parts: str) -> Column:
        within = Window.partitionBy(*parts).orderBy(*order)
        if weight is None:
            return F.row_number().over(within).cast("bigint")
        return combine(amount).over(within.rowsBetween(Window.unboundedPreceding, 0))

    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > hot_rows)
    if hot.isEmpty():
        return df.withColumn(name, ordered(*keys))
    data = df.withColumn("_range_by", range_by.cast("double"))
    sketch = F.percentile_approx("_range_by", [i / RANGES for i in range(1, RANGES)], 10 * RANGES)
    # The sketch depends on the order in which rows arrive, so ranges and the totals below them must share one result of it.
    if keys:
        cuts = settled(data.join(hot, keys, "left_semi").groupBy(*keys).agg(sketch.alias("_cuts")))
        cut = data.join(cuts, keys, "left")
    else:
        cut = data.withColumn("_cuts", settled(data.agg(sketch.alias("_cuts"))).scalar())
    place = _range_of(F.col("_cuts"), F.col("_range_by"))
    ranged = cut.withColumn("_range", F.when(F.col("_cuts").isNull(), F.lit(-1)).otherwise(place))
    below = (
        ranged.filter("_range >= 0")
        .groupBy(*keys, "_range")
        .agg(combine(amount).alias("_sum"))
        .withColumn(
            "_below",
            combine("_sum").over(
                Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .drop("_sum")
    )
    merged = (
        F.greatest("_inside", "_below") if how == "max" else F.col("_inside") + F.coalesce("_below", F.lit(0))
    )
    out = (
        ranged.withColumn("_inside", ordered(*keys, "_range"))
        .join(below, [*keys, "_range"], "left")
        .withColumn(name, merged)
    )
    return out.select(*df.columns, name)


def group_rank(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    range_by: Column,
    name: str = "rn",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """row_number() per key (BIGINT, from 1) without sorting a hot key in one task."""
    return running_total(df, keys, order, range_by, name, None, hot_rows)


def group_percentiles(
    df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Exact linear-interpolation percentiles per key; NULLs are ignored, ties pre-counted."""
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_w"))
    )
    placed = running_total(counted, keys, [F.col("_v")], F.col("_v"), "_upto", F.col("_w"), hot_rows)
    if keys:
        joined = placed.join(counted.groupBy(*keys).agg(F.sum("_w").alias("_n")), keys)
    else:
        joined = placed.withColumn("_n", counted.agg(F.sum("_w")).scalar())

    def value_at(index: Column) -> Column:
        hit = (F.col("_upto") - F.col("_w") <= index) & (index < F.col("_upto"))
        return F.max(F.when(hit, F.col("_v")))

    aggs = []
    for label, p in wanted.items():
        position = F.lit(float(p)) * (F.col("_n") - 1)
        aggs += [
            value_at(F.floor(position)).alias(f"_lo_{label}"),
            value_at(F.ceil(position)).alias(f"_hi_{label}"),
        ]
    picked = joined.groupBy(*keys, "_n").agg(*aggs)
    out = []
    for label, p in wanted.items():
        position = F.lit(float(p)) * (F.col("_n") - 1)
        out.append(
            (
                F.col(f"_lo_{label}")
                + (position - F.floor(position)) * (F.col(f"_hi_{label}") - F.col(f"_lo_{label}"))
            ).alias(label)
        )
    return picked.select(*keys, *out)


def bounded_groups(df: DataFrame, keys: list[str], limit: int, what: str) -> DataFrame:
    """Fail the job when a group exceeds `limit` rows; otherwise pass rows through unchanged."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    return (
        df.join(sizes, keys)
        .withColumn(
            "_ok",
            F.when(
                F.col("_size") > limit,
                F.raise_error(F.concat(F.lit(f"{what}: group larger than {limit} rows: "), F.col("_size").cast("string"))),
            ).otherwise(F.lit(True)),
        )
        .filter("_ok")
        .drop("_size", "_ok")
    )
