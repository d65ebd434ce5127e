"""Calibration of counts against concentrations, and concentration estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringeframe.functions.arrays import finite
from fringeframe.functions.distributions import t_critical_95, t_p_value
from fringeframe.operators.resample import hashed_lines, resampled_lines
from fringeframe.operators.settle import settled
from fringeframe.operators.skew import group_rank, running_total

FIELDS_PER_PREPARATION = 5
# Study gradient names.
GRADIENT_MAP = {"C0": "G0", "C1": "G1", "C3": "G2", "C5": "G3", "C7": "G4", "C8": "G5"}
# Published calibration line, particles/mL per count and particles/mL.
PUBLISHED_SLOPE = 7177.958896475087
PUBLISHED_INTERCEPT = 16.595417284901487


def preparations(fields: DataFrame) -> DataFrame:
    """One row per (gradient_id, preparation_id) with counts, means, sample SDs and completeness.

    `target` is the first non-NULL value over all fields; only include_flag = 1 rows are measured.
    A preparation is complete with exactly five included fields, all with both measurements.
    """
    inc = F.coalesce(F.col("include_flag"), F.lit(0)) == 1
    ref = F.when(inc, F.col("reference_conc"))
    ring = F.when(inc, F.col("ring_count"))
    target = [c for c in ["target"] if c in fields.columns]
    aggs = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("field_id"))).alias(c) for c in target]
    out = fields.groupBy("gradient_id", "preparation_id").agg(
        *aggs,
        F.count_if(inc).alias("n_included"),
        F.count(ref).alias("n_reference_fields"),
        F.count(ring).alias("n_ring_fields"),
        F.avg(ref).alias("mean_reference"),
        F.stddev_samp(ref).alias("sd_reference"),
        F.avg(ring).alias("mean_ring"),
        F.stddev_samp(ring).alias("sd_ring"),
    )
    five = FIELDS_PER_PREPARATION
    return out.withColumn(
        "complete",
        (F.col("n_included") == five) & (F.col("n_reference_fields") == five) & (F.col("n_ring_fields") == five),
    )


def preparation_status(prep: DataFrame) -> DataFrame:
    """Add the three-way `analysis_status` text."""
    return prep.withColumn(
        "analysis_status",
        F.when(F.col("complete"), "Included")
        .when(
            (F.col("n_reference_fields") == FIELDS_PER_PREPARATION) & (F.col("n_ring_fields") == 0),
            "Excluded: ring counts missing",
        )
        .otherwise("Excluded: paired measurements incomplete"),
    )


def map_gradients(prep: DataFrame) -> DataFrame:
    """Complete preparations with study gradient names; unknown names or fewer than four rows fail."""
    kept = prep.filter("complete")
    mapping = F.create_map(*[F.lit(x) for pair in GRADIENT_MAP.items() for x in pair])
    n = kept.agg(F.count(F.lit(1))).scalar()
    named = mapping[F.col("gradient_id")]
    return kept.withColumn("source_gradient_id", F.col("gradient_id")).withColumn(
        "gradient_id",
        F.when(
            named.isNull() | (n < 4),
            F.raise_error(F.lit("at least four complete preparations with known gradients are needed")),
        ).otherwise(named),
    )


def gradients(prep: DataFrame) -> DataFrame:
    """Mean and sample SD over preparations of each gradient."""
    return prep.groupBy("gradient_id").agg(
        F.count(F.lit(1)).alias("n_preparations"),
        F.avg("mean_reference").alias("mean_reference"),
        F.stddev_samp("mean_reference").alias("sd_reference"),
        F.avg("mean_ring").alias("mean_ring"),
        F.stddev_samp("mean_ring").alias("sd_ring"),
    )


def field_to_preparation(fields: DataFrame, value: str) -> DataFrame:
    """One field per row to one preparation per row: average after the field, never before."""
    return fields.groupBy("preparation_id").agg(
        F.count(value).alias("fields"), F.avg(value).alias(f"mean_{value}")
    )


def _line(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Sums of the least-squares line; unusable input (few rows, non-finite, constant x) fails the job."""
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    line = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~(finite(xs) & finite(ys))).alias("_bad"),
        F.avg(xs).alias("x_bar"),
        F.avg(ys).alias("y_bar"),
        F.regr_sxx(ys, xs).alias("sxx"),
        F.regr_syy(ys, xs).alias("sst"),
        F.regr_slope(ys, xs).alias("slope"),
        F.regr_intercept(ys, xs).alias("intercept"),
    )
    usable = (F.col("n") >= 3) & (F.col("_bad") == 0) & (F.col("sxx") > 0)
    return line.withColumn(
        "slope",
        F.when(usable, F.col("slope")).otherwise(
            F.raise_error(F.lit("a line needs three or more finite points and varying x"))
        ),
    ).drop("_bad")


def _joined(df: DataFrame, line: DataFrame, by: list[str]) -> DataFrame:
    """Rows with their group's line; a single line for the whole table is a scalar subquery."""
    if by:
        return df.join(line, by)
    whole = line.select(F.struct(*line.columns).alias("_line")).scalar()
    return df.withColumn("_line", whole).select("*", "_line.*").drop("_line")


def ols(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """One row per group: line, fit quality, standard errors and 95 % t intervals."""
    by = by or []
    line = _line(df, x, y, by)
    residual = F.col(y) - (F.col("intercept") + F.col("slope") * F.col(x))
    errors = (
        _joined(df, line, by)
        .groupBy(*by, "n", "x_bar", "y_bar", "sxx", "sst", "slope", "intercept")
        .agg(F.sum(residual * residual).alias("sse"), F.sum(F.abs(residual)).alias("_sae"))
    )
    n = F.col("n")
    out = (
        errors.withColumn("r2", 1.0 - F.col("sse") / F.col("sst"))
        .withColumn("adjusted_r2", 1.0 - (1.0 - F.col("r2")) * (n - 1) / (n - 2))
        .withColumn("rmse", F.sqrt(F.col("sse") / n))
        .withColumn("mae", F.col("_sae") / n)
        .withColumn("residual_se", F.sqrt(F.col("sse") / (n - 2)))
        .withColumn("slope_se", F.col("residual_se") / F.sqrt("sxx"))
        .withColumn(
            "intercept_se", F.col("residual_se") * F.sqrt(1.0 / n + F.col("x_bar") * F.col("x_bar") / F.col("sxx"))
        )
        .withColumn("t_crit", t_critical_95((n - 2).cast("double")))
        .drop("_sae")
    )
    for name in ("slope", "intercept"):
        half = F.col("t_crit") * F.col(f"{name}_se")
        out = out.withColumn(f"{name}_ci_low", F.col(name) - half).withColumn(f"{name}_ci_high", F.col(name) + half)
    return out


def leave_one_out(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Add fitted, residual and leave-one-out prediction; the closed form y - e/(1-h) needs no refits."""
    by = by or []
    rows = _joined(df, _line(df, x, y, by), by)
    dx = F.col(x) - F.col("x_bar")
    h = 1.0 / F.col("n") + dx * dx / F.col("sxx")
    left_out = F.when(
        (F.col("n") < 4) | (1.0 - h < 1e-12), F.raise_error(F.lit("a point left out leaves no line"))
    ).otherwise(F.col(y) - F.col("residual") / (1.0 - h))
    return (
        rows.withColumn("fitted", F.col("intercept") + F.col("slope") * F.col(x))
        .withColumn("residual", F.col(y) - F.col("fitted"))
        .withColumn("loo_prediction", left_out)
        .withColumn("loo_residual", F.col(y) - F.col("loo_prediction"))
        .select(*df.columns, "fitted", "residual", "loo_prediction", "loo_residual")
    )


def leave_one_out_scores(loo: DataFrame, y: str) -> DataFrame:
    """RMSE, MAE and R2 (against the full mean) of the leave-one-out residuals."""
    e = F.col("loo_residual")
    return loo.agg(
        F.sqrt(F.avg(e * e)).alias("loo_rmse"),
        F.avg(F.abs(e)).alias("loo_mae"),
        (1.0 - F.sum(e * e) / F.regr_syy(F.col(y), F.col(y))).alias("loo_r2"),
    )


def stratified_draws(
    df: DataFrame, x: str, y: str, stratum: str, order: str, iterations: int, seed: int
) -> DataFrame:
    """Slope and intercept per resample drawn within strata (NULL when x is constant).

    Draw (iteration, stratum, slot) picks row number hash mod n of its stratum. Rows with a NULL stratum are never drawn.
    """
    df = settled(df.filter(F.col(stratum).isNotNull()).select(stratum, order, x, y))
    ranked = group_rank(df, [stratum], [F.col(order)], F.col(order), "_rank").select(
        F.col(stratum).cast("string").alias("stratum"), (F.col("_rank") - 1).alias("pick"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")
    )
    sizes = df.groupBy(F.col(stratum).cast("string").alias("stratum")).agg(F.count(F.lit(1)).alias("size"))
    return hashed_lines(ranked, sizes, iterations, seed)


def _line_intervals(draws: DataFrame) -> DataFrame:
    bounds = [
        F.percentile(c, p).alias(f"{c}_ci_{side}")
        for c in ("slope", "intercept")
        for side, p in (("low", 0.025), ("high", 0.975))
    ]
    return draws.agg(
        F.count(F.lit(1)).alias("iterations"), F.count_if(F.col("slope").isNull()).alias("degenerate"), *bounds
    )


def stratified_bootstrap(
    df: DataFrame, x: str, y: str, stratum: str, order: str, iterations: int = 10_000, seed: int = 2026
) -> DataFrame:
    """One row: 95 % percentile intervals of slope and intercept and the number of degenerate draws."""
    return _line_intervals(resampled_lines(df, x, y, stratum, order, iterations, seed))


def stratified_bootstrap_hashed(
    df: DataFrame, x: str, y: str, stratum: str, order: str, iterations: int, seed: int = 2026
) -> DataFrame:
    """`stratified_bootstrap` with draws that are hashes of (seed, iteration, stratum, slot), which other engines can repeat; each costs a hash and four bytes."""
    return _line_intervals(stratified_draws(df, x, y, stratum, order, iterations, seed))


def curve(df: DataFrame, x: str, y: str, points: int = 240) -> DataFrame:
    """Fitted line with 95 % confidence and prediction bands from max(0, min x - 1) to max x + 2."""
    df = settled(df.select(x, y))
    ends = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    lo = F.greatest(F.lit(0.0), F.col("_lo") - 1.0)
    grid = F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)), lambda i: lo + (F.col("_hi") + 2.0 - lo) * i / (points - 1)
    )
    rows = _joined(ols(df, x, y), ends, []).select("*", F.posexplode(grid).alias("point", "x"))
    core = 1.0 / F.col("n") + (F.col("x") - F.col("x_bar")) * (F.col("x") - F.col("x_bar")) / F.col("sxx")
    fitted = F.col("intercept") + F.col("slope") * F.col("x")
    mean_half = F.col("t_crit") * F.col("residual_se") * F.sqrt(core)
    pred_half = F.col("t_crit") * F.col("residual_se") * F.sqrt(1.0 + core)
    return rows.select(
        "point",
        "x",
        fitted.alias("fitted"),
        (fitted - mean_half).alias("confidence_low"),
        (fitted + mean_half).alias("confidence_high"),
        (fitted - pred_half).alias("prediction_low"),
        (fitted + pred_half).alias("prediction_high"),
    )


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add average ranks (ties share their mean rank) over the whole table."""
    counted = df.groupBy(value).agg(F.count(F.lit(1)).alias("_w"))
    placed = running_total(counted, [], [F.col(value)], F.col(value), "_upto", F.col("_w"))
    ranks = placed.select(value, (F.col("_upto") - (F.col("_w") - 1) / 2.0).alias(name))
    return df.join(ranks, value)


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and Spearman coefficients with two-sided t p-values."""
    pairs = settled(df.select(x, y))
    ranked = average_ranks(average_ranks(pairs, x, "_rx"), y, "_ry")
    out = ranked.agg(
        F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("pearson_r"), F.corr("_rx", "_ry").alias("spearman_rho")
    )
    df_t = (F.col("n") - 2).cast("double")
    for r, p in (("pearson_r", "pearson_p"), ("spearman_rho", "spearman_p")):
        gap = 1.0 - F.col(r) * F.col(r)
        t = F.when(gap <= 0, F.lit(float("inf"))).otherwise(F.col(r) * F.sqrt(df_t / gap))
        out = out.withColumn(p, t_p_value(t, df_t))
    return out


def origin_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Line through the origin with RMSE, MAE and R2 against the mean."""
    slope = df.agg(F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))).scalar()
    rows = df.withColumn("_slope", slope).withColumn("_e", F.col(y) - F.col("_slope") * F.col(x))
    e = F.col("_e")
    return rows.agg(
        F.max("_slope").alias("slope"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1.0 - F.sum(e * e) / F.regr_syy(F.col(y), F.col(y))).alias("centered_r2"),
    )


def melt_metrics(row: DataFrame) -> DataFrame:
    """Columns of a one-row table to (metric, value) rows."""
    return row.select(*[F.col(c).cast("double").alias(c) for c in row.columns]).unpivot(
        [], row.columns, "metric", "value"
    )


def calibration_metrics(prep: DataFrame, iterations: int = 10_000, seed: int = 2026, bootstrap=stratified_bootstrap) -> DataFrame:
    """All calibration numbers of mapped preparations as one row."""
    prep = settled(prep)
    x, y = "mean_ring", "mean_reference"
    fit = ols(prep, x, y).select(
        F.col("n").alias("n_preparations"),
        "slope",
        "intercept",
        "r2",
        "adjusted_r2",
        "rmse",
        "mae",
        "residual_se",
        "slope_ci_low",
        "slope_ci_high",
        "intercept_ci_low",
        "intercept_ci_high",
    )
    loo = leave_one_out_scores(leave_one_out(prep, x, y), y)
    corr = correlations(prep, x, y).drop("n")
    zero = origin_fit(prep, x, y).select(*[F.col(c).alias(f"origin_{c}") for c in ("slope", "rmse", "mae", "centered_r2")])
    boot = bootstrap(prep, x, y, "gradient_id", "preparation_id", iterations, seed).select(
        *[F.col(f"{c}_ci_{s}").alias(f"{c}_boot_{s}") for c in ("slope", "intercept") for s in ("low", "high")]
    )
    out = fit
    for part in (loo, corr, zero, boot):
        out = _joined(out, part, [])
    return out


def class_counts(objects: DataFrame, fields: DataFrame, labels: list[str], field: str = "field_id") -> DataFrame:
    """(field, label, count) for every field and listed label, zeros kept."""
    counts = objects.groupBy(field, "label").agg(F.count(F.lit(1)).alias("_n"))
    grid = fields.select(field).distinct().select(field, F.explode(F.array(*[F.lit(l) for l in labels])).alias("label"))
    return grid.join(counts, [field, "label"], "left").select(field, "label", F.coalesce("_n", F.lit(0)).alias("count"))


def geometric_slope(valid_area_mm2: float, drop_volume_ul: float, wet_area_mm2: float) -> float:
    """Particles/mL per count from the imaged share of the drop."""
    return 1000.0 / (valid_area_mm2 * drop_volume_ul / wet_area_mm2)


def inverted_line(k: float, b: float) -> tuple[float, float]:
    """(slope, intercept) of concentration from a count line N = k*C + b."""
    if k <= 0:
        raise ValueError("calibration slope must be positive")
    return 1.0 / k, -b / k


def estimate(count: Column, slope: float, intercept: float) -> Column:
    """0 without particles, else max(0, slope*count + intercept)."""
    if slope <= 0:
        raise ValueError("calibration slope must be positive")
    return F.when(count <= 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.lit(slope) * count + F.lit(intercept))
    )


def concentration(counts: DataFrame, slope: float, intercept: float, field: str = "field_id") -> DataFrame:
    """Per field and label the estimate, and the estimate of the field's total count."""
    totals = counts.groupBy(field).agg(F.sum("count").alias("total_count"))
    return (
        counts.join(totals, field)
        .withColumn("concentration", estimate(F.col("count"), slope, intercept))
        .withColumn("total_concentration", estimate(F.col("total_count"), slope, intercept))
    )
