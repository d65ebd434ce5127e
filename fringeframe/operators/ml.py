"""Scaling, classifiers and linear scoring on feature tables (sample_id, class_index, features ARRAY<DOUBLE>)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringeframe.functions import arrays as A
from fringeframe.operators.evaluate import metrics
from fringeframe.operators.kernels import default_gamma, nystroem_features
from fringeframe.operators.neighbours import nearest_rows
from fringeframe.operators.settle import settled


def fit_scaler(df: DataFrame, value: str = "features") -> DataFrame:
    """One row (mean ARRAY, scale ARRAY): population SD per feature, 1 where it is 0."""
    stats = df.select(F.posexplode(value).alias("i", "v")).groupBy("i").agg(
        F.avg("v").alias("m"), F.stddev_pop("v").alias("s")
    )
    packed = stats.agg(F.sort_array(F.collect_list(F.struct("i", "m", "s"))).alias("p"))
    return packed.select(
        F.transform("p", lambda t: t["m"]).alias("mean"),
        F.transform("p", lambda t: F.when(t["s"] == 0, F.lit(1.0)).otherwise(t["s"])).alias("scale"),
    )


def scale(df: DataFrame, scaler: DataFrame, value: str = "features") -> DataFrame:
    """Replace features by (x - mean) / scale."""
    whole = scaler.select(F.struct("mean", "scale")).scalar()
    centred = F.zip_with(value, F.col("_s.mean"), lambda x, m: x - m)
    return df.withColumn("_s", whole).withColumn(value, F.zip_with(centred, F.col("_s.scale"), lambda x, s: x / s)).drop("_s")


def balanced_weights(df: DataFrame, label: str = "class_index") -> DataFrame:
    """Add `weight` = n / (classes * class size)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    whole = sizes.agg(F.struct(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    weights = sizes.withColumn("_w", whole).select(label, (F.col("_w.n") / (F.col("_w.k") * F.col("_n"))).alias("weight"))
    return df.join(weights, label)


def with_vector(df: DataFrame, value: str = "features") -> DataFrame:
    return df.withColumn("vector", array_to_vector(value))


def packed(df: DataFrame, values: int, per_task: int = 2_000_000) -> DataFrame:
    """Fewer tasks for small training sets: an iterative fit pays one round of tasks per step."""
    return df.coalesce(values // per_task + 1)


def estimator(name: str, n: int, width: int, classes: int, c: float = 1.0, seed: int = 2026):
    """MLlib estimator by name. C becomes regParam 1/(C*n).

    Unlike the usual single-machine defaults, linear_svm minimises hinge (not squared hinge) loss and the
    network has neither dropout nor early stopping, so decision scores differ.
    """
    common = dict(featuresCol="vector", labelCol="class_index", predictionCol="_prediction")
    reg = 1.0 / (c * n)
    if name == "logistic_regression_l2":
        return LogisticRegression(**common, weightCol="weight", regParam=reg, maxIter=100, probabilityCol="_p", rawPredictionCol="_r")
    if name == "linear_svm":
        svc = LinearSVC(featuresCol="vector", regParam=reg, maxIter=50)
        return OneVsRest(classifier=svc, **common, weightCol="weight", parallelism=4)
    if name == "kernel_svm":
        # Kernel features carry their scale: the penalty is the kernel's own norm.
        svc = LinearSVC(featuresCol="vector", regParam=reg, maxIter=200, standardization=False)
        return OneVsRest(classifier=svc, **common, weightCol="weight", parallelism=4)
    if name == "random_forest":
        return RandomForestClassifier(
            **common, weightCol="weight", numTrees=100, seed=seed, probabilityCol="_p", rawPredictionCol="_r"
        )
    if name == "gradient_boosting":
        gbt = GBTClassifier(featuresCol="vector", maxIter=20, seed=seed)
        return OneVsRest(classifier=gbt, **common, weightCol="weight", parallelism=4)
    if name == "tiny_mlp":
        return MultilayerPerceptronClassifier(
            **common, layers=[width, 96, classes], maxIter=100, seed=seed, probabilityCol="_p", rawPredictionCol="_r"
        )
    raise ValueError(name)


def fit_predict(name: str, train: DataFrame, test: DataFrame, c: float | None = None, seed: int = 2026) -> DataFrame:
    """Standardise on train, fit, and return test rows with `predicted_index`.

    `svm_rbf` and `knn_5` are handled here as well. c defaults to 10 for `svm_rbf`, else to 1.
    """
    c = (10.0 if name == "svm_rbf" else 1.0) if c is None else c
    scaler = settled(fit_scaler(train))
    a, b = scale(train, scaler), scale(test, scaler)
    if name == "knn_5":
        return knn_classify(a, b, 5)
    if name == "svm_rbf":
        a, b = (df.drop("residual") for df in nystroem_features(a, b, seed=seed))
        name = "kernel_svm"
    a = settled(balanced_weights(with_vector(a)))
    facts = a.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("w"), F.max("class_index").alias("k")
    ).first()
    model = estimator(name, facts["n"], facts["w"], int(facts["k"]) + 1, c, seed).fit(packed(a, facts["n"] * facts["w"]))
    scored = model.transform(with_vector(b)).withColumn("predicted_index", F.col("_prediction").cast("bigint"))
    return scored.drop("_prediction", "_p", "_r", "rawPrediction", "vector")


def fourier_features(train: DataFrame, test: DataFrame, size: int = 300, gamma: float | None = None, seed: int = 2026):
    """Random cosine features approximating the RBF kernel (Rahimi and Recht 2007), for train and test.

    gamma defaults to 1/(features * variance of all training values). The kernel is approximate.
    """
    gamma = default_gamma(train) if gamma is None else gamma

    def mapped(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    x = np.asarray(batch["features"].tolist(), dtype=float)
                    rng = np.random.default_rng(seed)
                    w = rng.normal(0.0, np.sqrt(2.0 * gamma), (x.shape[1], size))
                    z = np.sqrt(2.0 / size) * np.cos(x @ w + rng.uniform(0.0, 2.0 * np.pi, size))
                    batch = batch.assign(features=list(z))
                yield batch

        return df.mapInPandas(run, df.schema)

    return mapped(train), mapped(test)


def knn_classify(train: DataFrame, test: DataFrame, k: int = 5) -> DataFrame:
    """Distance-weighted vote of the k nearest training rows; a zero distance decides alone, ties to the lowest class."""
    near = nearest_rows(train, test, k)
    exact = near.groupBy("query_id").agg(F.bool_or(F.col("distance") == 0).alias("_exact"))
    weight = F.when(F.col("_exact"), F.when(F.col("distance") == 0, 1.0).otherwise(0.0)).otherwise(1.0 / F.col("distance"))
    votes = near.join(exact, "query_id").groupBy("query_id", "class_index").agg(F.sum(weight).alias("_w"))
    winner = votes.groupBy("query_id").agg(
        F.max_by("class_index", F.struct(F.col("_w"), -F.col("class_index"))).alias("predicted_index")
    )
    return test.join(winner.withColumnRenamed("query_id", "sample_id"), "sample_id")


def classical_domain(real: DataFrame, augmented: DataFrame | None) -> DataFrame:
    """Training rows of one scenario: real rows, plus augmented rows where given."""
    columns = ["sample_id", "class_index", "features"]
    return real.select(*columns) if augmented is None else real.select(*columns).unionByName(augmented.select(*columns))


def scenario_grid(scenarios: dict[str, DataFrame], test: DataFrame, models: list[str], seed: int = 2026) -> DataFrame:
    """Long predictions (scenario, model, sample_id, true_index, predicted_index) of every training set and model."""
    out = None
    for scenario, train in scenarios.items():
        for model in models:
            part = fit_predict(model, train, test, seed=seed).select(
                F.lit(scenario).alias("scenario"),
                F.lit(model).alias("model"),
                "sample_id",
                F.col("class_index").alias("true_index"),
                "predicted_index",
            )
            out = part if out is None else out.unionByName(part)
    return out


def scenario_metrics(predictions: DataFrame) -> DataFrame:
    return metrics(predictions, ["scenario", "model"])


def score_linear(df: DataFrame, model: DataFrame, variant: str = "spectral_radial_stats") -> DataFrame:
    """Add predicted_index, margin (best minus second score) and scores.

    `model`: one row (mean, scale, classes ARRAY<BIGINT>, coefficients ARRAY<ARRAY>, intercepts ARRAY).
    The selected-only variant drops six trailing features; any other length mismatch fails the job. A missing (NULL) feature adds
    nothing to a score, as if it were the training mean; a row without any feature gets no prediction.
    """
    whole = model.select(F.struct("mean", "scale", "classes", "coefficients", "intercepts")).scalar()
    width = F.size("_m.mean")
    x = F.col("features")
    if variant == "selected_spectral_radial":
        x = F.when(F.size(x) == width + 6, F.slice(x, 1, width)).otherwise(x)
    checked = F.when(
        F.size(x) == width, x
    ).otherwise(F.raise_error(F.lit("feature count does not match the model")))
    z = F.zip_with(
        F.zip_with(checked, F.col("_m.mean"), lambda v, m: v - m),
        F.col("_m.scale"),
        lambda v, s: F.coalesce(v / F.when(s == 0, F.lit(1.0)).otherwise(s), F.lit(0.0)),
    )
    known = (F.size("features") == 0) | F.exists("features", lambda v: v.isNotNull())
    scores = A.let(
        F.struct(z.alias("z"), F.col("_m.coefficients").alias("c"), F.col("_m.intercepts").alias("b")),
        lambda t: F.transform(t["c"], lambda w, i: A.dot(w, t["z"]) + A.at(t["b"], i)),
    )
    best = A.let(F.col("scores"), lambda s: F.array_position(s, F.array_max(s)) - 1)
    margin = A.let(F.sort_array("scores", asc=False), lambda s: A.at(s, F.lit(0)) - A.at(s, F.lit(1)))
    return (
        df.withColumn("_m", whole)
        .withColumn("scores", F.when(known, scores))
        .withColumn("predicted_index", A.at(F.col("_m.classes"), best))
        .withColumn("margin", margin)
        .drop("_m")
    )


def centroid_model(train: DataFrame) -> DataFrame:
    """Linear model row of the nearest class mean on standardised features: coefficients mu, intercept -|mu|^2/2."""
    scaler = fit_scaler(train)
    means = (
        scale(train, scaler)
        .select("class_index", F.posexplode("features").alias("i", "v"))
        .groupBy("class_index", "i")
        .agg(F.avg("v").alias("m"))
        .groupBy("class_index")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mu"))
    )
    packed = means.agg(F.sort_array(F.collect_list(F.struct("class_index", "mu"))).alias("c"))
    whole = scaler.select(F.struct("mean", "scale")).scalar()
    return packed.withColumn("_s", whole).select(
        "_s.mean",
        "_s.scale",
        F.transform("c", lambda s: s["class_index"]).alias("classes"),
        F.transform("c", lambda s: s["mu"]).alias("coefficients"),
        F.transform("c", lambda s: A.dot(s["mu"], s["mu"]) * -0.5).alias("intercepts"),
    )


def linear_model_row(model, scaler: DataFrame) -> DataFrame:
    """Model row of a fitted multinomial logistic regression for `score_linear`."""
    spark = scaler.sparkSession
    coefficients = model.coefficientMatrix.toArray().tolist()
    rows = [(list(range(len(coefficients))), coefficients, model.interceptVector.toArray().tolist())]
    fitted = spark.createDataFrame(rows, "classes array<bigint>, coefficients array<array<double>>, intercepts array<double>")
    whole = scaler.select(F.struct("mean", "scale")).scalar()
    return fitted.withColumn("_s", whole).select("_s.mean", "_s.scale", "classes", "coefficients", "intercepts")


def parity_check(expected: DataFrame, actual: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows whose stored prediction differs from the fresh one or is missing; empty means the artifact agrees."""
    return expected.select(key, "predicted_index").join(
        actual.select(key, "predicted_index"), [key, "predicted_index"], "left_anti"
    )


def pca2(df: DataFrame) -> DataFrame:
    """Add pc1 and pc2 of standardised features; each component's largest loading is positive."""
    scaled = settled(with_vector(scale(df, fit_scaler(df))))
    model = PCA(k=2, inputCol="vector", outputCol="_pc").fit(scaled)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[np.argmax(np.abs(loadings[:, j])), j] >= 0 else -1.0 for j in range(2)]
    out = model.transform(scaled).withColumn("_pc", vector_to_array("_pc"))
    return out.select(*df.columns, *[(F.col("_pc")[j] * signs[j]).alias(f"pc{j + 1}") for j in range(2)])


def as_features(spectra: DataFrame, value: str = "spectrum") -> DataFrame:
    return spectra.select("sample_id", "class_index", F.col(value).alias("features"))


def holdout(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(train, test): rows where the condition is false, true."""
    return df.filter(~condition), df.filter(condition)
