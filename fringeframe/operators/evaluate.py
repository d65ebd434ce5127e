"""Classifier evaluation: confusion tables, scores, paired tests and resampling intervals.

Predictions are long: one row per (model keys, sample) with `true_index` and `predicted_index`.
Everything after the first aggregate works on label-sized tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from fringeframe.functions.distributions import incomplete_beta
from fringeframe.functions.draws import draw_index
from fringeframe.operators.resample import resampled_sums
from fringeframe.operators.settle import dealt, settled
from fringeframe.operators.skew import group_rank, running_total

MAX_CELLS = 200_000


def _safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def confusion(pred: DataFrame, by: list[str], labels: list[int]) -> DataFrame:
    """(by..., true_index, predicted_index, n) over the full label grid, zeros kept."""
    counts = pred.groupBy(*by, "true_index", "predicted_index").agg(F.count(F.lit(1)).alias("_n"))
    models = counts.select(*by).distinct() if by else pred.sparkSession.range(1).select()
    axis = F.array(*[F.lit(int(k)).cast("bigint") for k in labels])
    grid = models.select(*by, F.explode(axis).alias("true_index")).select(
        "*", F.explode(axis).alias("predicted_index")
    )
    return grid.join(counts, [*by, "true_index", "predicted_index"], "left").select(
        *by, "true_index", "predicted_index", F.coalesce("_n", F.lit(0)).alias("n")
    )


def confusion_wide(conf: DataFrame, by: list[str], labels: list[int], value: str = "n") -> DataFrame:
    """One row per true label, one column per predicted label (`predicted_<k>`)."""
    wide = conf.groupBy(*by, "true_index").pivot("predicted_index", labels).agg(F.sum(value))
    return wide.select(*by, "true_index", *[F.col(f"`{k}`").alias(f"predicted_{k}") for k in labels])


def confusion_rates(conf: DataFrame, by: list[str]) -> DataFrame:
    """Add `rate`: share of the true label's row, 0 for an empty row."""
    row = F.sum("n").over(Window.partitionBy(*by, "true_index"))
    return conf.withColumn("rate", _safe_ratio(F.col("n"), row))


def class_report(pred: DataFrame, by: list[str], labels: list[int] | None = None) -> DataFrame:
    """(by..., label, tp, support, predicted, precision, recall, f1); zero where undefined.

    Without `labels`, the labels are those seen in truth or prediction.
    """
    counts = pred.groupBy(*by, "true_index", "predicted_index").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    side = lambda label, tp, support, predicted: F.struct(
        label.cast("bigint").alias("label"), tp.alias("tp"), support.alias("support"), predicted.alias("predicted")
    )
    n, t, p = F.col("n"), F.col("true_index"), F.col("predicted_index")
    parts = [side(t, F.when(t == p, n).otherwise(zero), n, zero), side(p, zero, zero, n)]
    exploded = counts.select(*by, F.explode(F.array(*parts)).alias("s")).select(*by, "s.*")
    if labels is not None:
        filler = F.array(*[side(F.lit(k), zero, zero, zero) for k in labels])
        models = counts.select(*by).distinct() if by else counts.limit(1).select()
        exploded = exploded.filter(F.col("label").isin(labels)).unionByName(
            models.select(*by, F.explode(filler).alias("s")).select(*by, "s.*")
        )
    report = exploded.groupBy(*by, "label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted")
    )
    return (
        report.withColumn("precision", _safe_ratio(F.col("tp"), F.col("predicted")))
        .withColumn("recall", _safe_ratio(F.col("tp"), F.col("support")))
        .withColumn("f1", _safe_ratio(2.0 * F.col("tp"), F.col("predicted") + F.col("support")))
    )


def metrics(pred: DataFrame, by: list[str], labels: list[int] | None = None) -> DataFrame:
    """(by..., n, accuracy, balanced_accuracy, macro_f1, weighted_f1, mcc).

    `labels` fixes the macro-F1 label set; balanced accuracy averages over labels present in truth.
    """
    report = class_report(pred, by)
    if labels is not None:
        models = report.select(*by).distinct() if by else report.limit(1).select()
        axis = models.select(*by, F.explode(F.array(*[F.lit(k).cast("bigint") for k in labels])).alias("label"))
        report = report.join(axis.withColumn("_listed", F.lit(True)), [*by, "label"], "full_outer").fillna(
            0, ["tp", "support", "predicted", "precision", "recall", "f1"]
        )
        macro = F.avg(F.when(F.col("_listed"), F.col("f1")))
    else:
        macro = F.avg("f1")
    d = lambda c: F.col(c).cast("double")
    sums = report.groupBy(*by).agg(
        F.sum("support").alias("n"),
        F.sum(d("tp")).alias("_c"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        macro.alias("macro_f1"),
        F.sum(d("f1") * d("support")).alias("_wf"),
        F.sum(d("predicted") * d("support")).alias("_pt"),
        F.sum(d("predicted") * d("predicted")).alias("_pp"),
        F.sum(d("support") * d("support")).alias("_tt"),
    )
    s = d("n")
    denominator = F.sqrt((s * s - F.col("_pp")) * (s * s - F.col("_tt")))
    return sums.select(
        *by,
        "n",
        _safe_ratio(F.col("_c"), s).alias("accuracy"),
        "balanced_accuracy",
        "macro_f1",
        _safe_ratio(F.col("_wf"), s).alias("weighted_f1"),
        _safe_ratio(F.col("_c") * s - F.col("_pt"), denominator).alias("mcc"),
    )


def paired_tables(pred: DataFrame, pairs: list[tuple[str, str]], model: str = "model", sample: str = "sample_id") -> DataFrame:
    """(model_a, model_b, both_right, both_wrong, a_only, b_only) for each named pair.

    One shuffle by sample for all pairs; a sample missing from any named model, or repeated in one, fails the job.
    """
    names = sorted({m for pair in pairs for m in pair})
    right = F.when(F.col("true_index") == F.col("predicted_index"), 1).otherwise(0)
    own = lambda m: F.col(model) == m
    wide = (
        pred.filter(F.col(model).isin(names))
        .groupBy(sample)
        .agg(
            *[F.max(F.when(own(m), right)).alias(f"_{i}") for i, m in enumerate(names)],
            *[F.count_if(own(m)).alias(f"_n{i}") for i, m in enumerate(names)],
        )
    )
    whole, once = F.lit(True), F.lit(True)
    for i in range(len(names)):
        whole = whole & (F.col(f"_n{i}") > 0)
        once = once & (F.col(f"_n{i}") <= 1)
    wide = wide.filter(
        F.when(~whole, F.raise_error(F.lit("models cover different samples")))
        .when(~once, F.raise_error(F.lit("a model has a sample more than once")))
        .otherwise(F.lit(True))
    )
    cell = lambda a, b, va, vb: F.count_if((F.col(f"_{names.index(a)}") == va) & (F.col(f"_{names.index(b)}") == vb))
    rows = [
        F.struct(
            F.lit(a).alias("model_a"),
            F.lit(b).alias("model_b"),
            cell(a, b, 1, 1).alias("both_right"),
            cell(a, b, 0, 0).alias("both_wrong"),
            cell(a, b, 1, 0).alias("a_only"),
            cell(a, b, 0, 1).alias("b_only"),
        )
        for a, b in pairs
    ]
    return wide.agg(F.array(*rows).alias("_rows")).select(F.explode("_rows").alias("_r")).select("_r.*")


def exact_mcnemar(b: int, c: int) -> float:
    """Two-sided exact binomial test on the discordant counts; 1 without any."""
    n, k = b + c, min(b, c)
    if n == 0:
        return 1.0
    return min(1.0, 2.0 * incomplete_beta(n - k, k + 1.0, 0.5))


@pandas_udf(DoubleType())
def mcnemar_p(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([exact_mcnemar(int(i), int(j)) for i, j in zip(b, c)], dtype="float64")


def holm(df: DataFrame, p: str, tie: str, alpha: float = 0.05) -> DataFrame:
    """Add `p_holm` and `significant`: step-down over all rows, ties ordered by `tie`."""
    m = df.agg(F.count(F.lit(1))).scalar()
    ranked = group_rank(df, [], [F.col(p), F.col(tie)], F.col(p), "_rank")
    scaled = ranked.withColumn("_scaled", (m - F.col("_rank") + 1) * F.col(p))
    running = running_total(
        scaled, [], [F.col("_rank")], F.col("_rank"), "_max", F.col("_scaled"), how="max"
    )
    out = running.withColumn("p_holm", F.least(F.lit(1.0), F.col("_max")))
    return out.select(*df.columns, "p_holm", (F.col("p_holm") < alpha).alias("significant"))


def _cells(pred: DataFrame, columns: list[str]) -> Column:
    """Counts of distinct label combinations as one sorted array: bounded by the label sets, not the rows."""
    counted = pred.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    packed = counted.agg(
        F.sort_array(F.collect_list(F.struct(*columns, "n"))).alias("cells"), F.count(F.lit(1)).alias("size")
    )
    too_many = F.raise_error(F.lit("too many label combinations to resample"))
    return packed.select(F.when(F.col("size") > MAX_CELLS, too_many).otherwise(F.col("cells"))).scalar()


def _macro_f1(tp: np.ndarray, support: np.ndarray, predicted: np.ndarray, fixed: bool) -> float:
    size = support + predicted
    f1 = np.divide(2.0 * tp, size, out=np.zeros(len(size)), where=size > 0)
    return float(f1.mean()) if fixed else float(f1[size > 0].mean())


def _resample(cells, iteration: int, seed: int, columns: list[str], labels: np.ndarray, fixed: bool):
    """Accuracy and macro-F1 of each prediction column on one multinomial resample of the cells."""
    grid = np.asarray([[c[k] for k in (*columns, "n")] for c in cells], dtype=np.int64)
    counts, n = grid[:, -1], int(grid[:, -1].sum())
    drawn = np.random.default_rng([seed, iteration]).multinomial(n, counts / n)
    size = len(labels)

    def place(values: np.ndarray) -> np.ndarray:
        """Index in `labels`; a label that is not listed gets a bin of its own that no score reads."""
        at = np.minimum(np.searchsorted(labels, values), size - 1)
        return np.where(labels[at] == values, at, size)

    truth = place(grid[:, 0])
    out = []
    for j in range(1, len(columns)):
        guess = place(grid[:, j])
        hit = grid[:, 0] == grid[:, j]
        support = np.bincount(truth, drawn, size + 1)[:size]
        predicted = np.bincount(guess, drawn, size + 1)[:size]
        tp = np.bincount(truth[hit], drawn[hit], size + 1)[:size]
        out += [drawn[hit].sum() / n, _macro_f1(tp, support, predicted, fixed)]
    return out


def _resamples(pred: DataFrame, columns: list[str], labels: list[int], iterations: int, seed: int, fixed: bool) -> DataFrame:
    ordered = np.asarray(sorted(labels))
    names = [f"{m}_{c}" for c in columns[1:] for m in ("accuracy", "macro_f1")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                [i, *_resample(cells, int(i), seed, columns, ordered, fixed)]
                for i, cells in zip(batch["id"], batch["cells"])
            ]
            yield pd.DataFrame(rows, columns=["iteration", *names])

    schema = "iteration bigint, " + ", ".join(f"`{n}` double" for n in names)
    start = pred.sparkSession.range(iterations).withColumn("cells", _cells(pred, columns))
    return start.mapInPandas(run, schema)


def _interval(value: Column, name: str) -> list[Column]:
    return [F.percentile(value, 0.025).alias(f"{name}_ci_low"), F.percentile(value, 0.975).alias(f"{name}_ci_high")]


def paired_bootstrap(
    pred: DataFrame, truth: str, a: str, b: str, labels: list[int], iterations: int = 5000, seed: int = 2026
) -> DataFrame:
    """One row: 95 % percentile intervals of accuracy and macro-F1 differences between columns a and b.

    Resampling rows with replacement is a multinomial draw over the (truth, a, b) combinations, so
    the cost does not grow with the table after one aggregate.
    """
    draws = _resamples(pred, [truth, a, b], labels, iterations, seed, True)
    acc = F.col(f"accuracy_{a}") - F.col(f"accuracy_{b}")
    f1 = F.col(f"macro_f1_{a}") - F.col(f"macro_f1_{b}")
    return draws.agg(
        F.count(F.lit(1)).alias("iterations"), *_interval(acc, "accuracy_delta"), *_interval(f1, "macro_f1_delta")
    )


def bootstrap_ci(pred: DataFrame, truth: str, a: str, labels: list[int], iterations: int = 5000, seed: int = 2026) -> DataFrame:
    """One row: 95 % intervals of one model's accuracy and macro-F1; classes absent from a draw drop out."""
    draws = _resamples(pred, [truth, a], labels, iterations, seed, False)
    return draws.agg(
        F.count(F.lit(1)).alias("iterations"),
        *_interval(F.col(f"accuracy_{a}"), "accuracy"),
        *_interval(F.col(f"macro_f1_{a}"), "macro_f1"),
    )


def slots(n: Column, chunk: int = 65536) -> Column:
    """Array of chunk starts 0, chunk, ... below n; see `explode_slots`."""
    return F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(chunk).cast("bigint"))


def explode_slots(df: DataFrame, n: str, name: str, chunk: int = 65536) -> DataFrame:
    """One row per slot 0..n-1, generated in bounded chunks rather than one long array."""
    last = F.least(F.col("_from") + (chunk - 1), F.col(n) - 1)
    return df.withColumn("_from", F.explode(slots(F.col(n), chunk))).withColumn(
        name, F.explode(F.sequence(F.col("_from"), last))
    ).drop("_from")


def _cluster_sums(pred: DataFrame, cluster: str) -> DataFrame:
    right = F.sum(F.when(F.col("true_index") == F.col("predicted_index"), 1).otherwise(0))
    return pred.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"), right.alias("_right"))


def _accuracy_interval(per_draw: DataFrame, sums: DataFrame) -> DataFrame:
    point = sums.agg(F.sum("_right") / F.sum("_n")).scalar()
    return per_draw.agg(
        F.count(F.lit(1)).alias("iterations"), *_interval(F.col("_right") / F.col("_n"), "accuracy")
    ).withColumn("accuracy", point)


def cluster_bootstrap(pred: DataFrame, cluster: str, iterations: int = 5000, seed: int = 2026) -> DataFrame:
    """One row: accuracy and its 95 % interval when whole clusters are drawn with replacement."""
    sums = settled(_cluster_sums(pred, cluster))
    return _accuracy_interval(resampled_sums(sums, None, cluster, ["_n", "_right"], iterations, seed), sums)


def cluster_bootstrap_hashed(pred: DataFrame, cluster: str, iterations: int, seed: int = 2026) -> DataFrame:
    """`cluster_bootstrap` with draws that are hashes of (seed, iteration, slot), which other engines can repeat; each costs a joined row."""
    sums = _cluster_sums(pred, cluster)
    ranked = group_rank(sums, [], [F.col(cluster)], F.col(cluster), "_rank").select(
        (F.col("_rank") - 1).alias("_pick"), "_n", "_right"
    )
    size = sums.agg(F.count(F.lit(1))).scalar()
    draws = explode_slots(
        pred.sparkSession.range(iterations).select(F.col("id").alias("iteration"), size.alias("_m")), "_m", "slot"
    ).withColumn("_pick", draw_index(F.col("_m"), seed, F.col("iteration"), F.col("slot")))
    per_draw = draws.join(ranked, "_pick").groupBy("iteration").agg(F.sum("_right").alias("_right"), F.sum("_n").alias("_n"))
    return _accuracy_interval(per_draw, sums)


# Rows whose votes a task counts.
VOTES_PER_TASK = 500_000


def majority_vote(pred: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """One prediction per key over repeated runs; ties go to the lowest class index.

    The number of tasks grows with the rows (counted, if not given), as each holds the counts of its keys.
    """
    return (
        dealt(pred, keys, pred.count() if rows is None else rows, VOTES_PER_TASK)
        .groupBy(*keys, "true_index", "predicted_index")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*keys, "true_index")
        .agg(F.max_by("predicted_index", F.struct(F.col("_n"), -F.col("predicted_index"))).alias("predicted_index"))
    )


def seed_summary(pred: DataFrame, model: str = "model", run: str = "seed", labels: list[int] | None = None) -> DataFrame:
    """Per model: mean and sample SD of scores over runs (SD 0 for one run), flagged best by macro-F1,
    and exact paired p-values of the majority votes against the best model (itself: 1).

    A sample that some model lacks fails the job."""
    per_run = metrics(pred, [model, run], labels)
    names = ["accuracy", "balanced_accuracy", "macro_f1", "weighted_f1", "mcc"]
    aggs = [F.count(F.lit(1)).alias("runs")]
    for n in names:
        aggs += [F.avg(n).alias(f"{n}_mean"), F.coalesce(F.stddev_samp(n), F.lit(0.0)).alias(f"{n}_sd")]
    summary = per_run.groupBy(model).agg(*aggs)
    best = summary.agg(F.max_by(F.col(model), F.struct(F.col("macro_f1_mean"), F.col("accuracy_mean")))).scalar()
    rows = pred.count()
    votes = majority_vote(pred, [model, "sample_id"], rows).select(
        model, "sample_id", (F.col("true_index") == F.col("predicted_index")).cast("int").alias("_right")
    )
    # The joins below are by sample: each keeps this deal.
    votes = dealt(votes, ["sample_id"], rows, VOTES_PER_TASK)
    reference = votes.filter(F.col(model) == best).select("sample_id", F.col("_right").alias("_ref"))
    models = summary.agg(F.count(F.lit(1))).scalar()
    covered = votes.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_models"))
    uneven = F.raise_error(F.lit("models cover different samples"))
    checked = covered.filter(F.when(F.col("_models") != models, uneven).otherwise(F.lit(True))).select("sample_id")
    discordant = (
        votes.join(checked, "sample_id")
        .join(reference, "sample_id")
        .groupBy(model)
        .agg(
            F.count_if((F.col("_ref") == 1) & (F.col("_right") == 0)).alias("reference_only"),
            F.count_if((F.col("_ref") == 0) & (F.col("_right") == 1)).alias("model_only"),
        )
    )
    return (
        summary.join(discordant, model)
        .withColumn("is_reference", F.col(model) == best)
        .withColumn("p_vs_reference", mcnemar_p("reference_only", "model_only"))
    )


def domain_rank(scores: DataFrame, a: str, b: str, eligible: str, tie: str) -> DataFrame:
    """Harmonic mean of two scores, best eligible candidate only."""
    s = F.col(a) + F.col(b)
    return (
        scores.withColumn("combined", _safe_ratio(2.0 * F.col(a) * F.col(b), s))
        .filter(F.col(eligible))
        .orderBy(F.desc("combined"), F.desc(a), tie)
        .limit(1)
    )


def end_to_end_f1(correct: Column, predicted: Column, truth: Column) -> list[Column]:
    """precision, recall and f1 of class-correct matches over predicted and labelled centers."""
    p, r = _safe_ratio(correct, predicted), _safe_ratio(correct, truth)
    return [
        p.alias("precision"),
        r.alias("recall"),
        F.when(p + r == 0, F.lit(0.0)).otherwise(2.0 * p * r / (p + r)).alias("f1"),
    ]


# Model names and whether an accelerator runs them.
DEPLOYMENT_TRAITS = [
    ("logistic_regression_l2", True),
    ("linear_svm", True),
    ("svm_rbf", False),
    ("random_forest", False),
    ("gradient_boosting", False),
    ("knn_5", False),
    ("tiny_mlp", True),
]


def deployment_score(models: DataFrame) -> DataFrame:
    """Add traits and `score` = 100 F1 + 2.5 friendly - 0.35 ln(1+KB) - 0.08 ms - 3 for the neighbour model.

    `models`: model, macro_f1, model_size_kb, latency_ms; an unknown model fails the job.
    """
    traits = models.sparkSession.createDataFrame(
        DEPLOYMENT_TRAITS, "model string, friendly boolean"
    )
    joined = models.join(F.broadcast(traits), "model", "left").withColumn(
        "friendly",
        F.when(F.col("friendly").isNull(), F.raise_error(F.lit("unknown model"))).otherwise(F.col("friendly")),
    )
    score = (
        100.0 * F.col("macro_f1")
        + F.when(F.col("friendly"), 2.5).otherwise(0.0)
        - 0.35 * F.log1p("model_size_kb")
        - 0.08 * F.col("latency_ms")
        - F.when(F.col("model") == "knn_5", 3.0).otherwise(0.0)
    )
    return joined.withColumn("score", score)


def union_predictions(tables: dict[str, DataFrame], sample: str = "sample_id") -> DataFrame:
    """Predictions of several domains with `domain` and `sample_key` = domain:sample; absent columns NULL."""
    out = None
    for domain, df in tables.items():
        tagged = df.withColumn("domain", F.lit(domain)).withColumn(
            "sample_key", F.concat_ws(":", F.lit(domain), F.col(sample).cast("string"))
        )
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def wide_predictions(pred: DataFrame, keys: list[str], models: list[str], model: str = "model") -> DataFrame:
    """One row per sample, one column per model."""
    return pred.groupBy(*keys).pivot(model, models).agg(F.max("predicted_index"))


def best_epoch(log: DataFrame, run: str = "run") -> DataFrame:
    """Per run, the first epoch of highest 0.1*(box+pose mAP50) + 0.9*(box+pose mAP50-95)."""
    fitness = 0.1 * (F.col("box_map50") + F.col("pose_map50")) + 0.9 * (F.col("box_map5095") + F.col("pose_map5095"))
    return (
        log.withColumn("_f", fitness)
        .groupBy(run)
        .agg(F.max_by("epoch", F.struct(F.col("_f"), -F.col("epoch"))).alias("best_epoch"), F.max("_f").alias("fitness"))
    )
