"""RBF kernel features from landmark rows (Nyström), with the error of the kernel they stand for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

LANDMARKS = 300
# Rows that a task maps at once.
ROWS_AT_ONCE = 1024


def default_gamma(train: DataFrame) -> float:
    """1 / (features * variance of all training values)."""
    facts = train.select(F.explode("features").alias("v")).agg(F.var_pop("v").alias("v")).first()
    width = train.agg(F.max(F.size("features"))).first()[0]
    return 1.0 / (width * (facts["v"] or 1.0))


def nystroem_features(
    train: DataFrame, test: DataFrame, landmarks: int = LANDMARKS, gamma: float | None = None, seed: int = 2026
) -> tuple[DataFrame, DataFrame]:
    """`train` and `test` with features whose inner products approximate the RBF kernel, and `residual`.

    Landmarks are the `landmarks` training rows of smallest seeded hash of sample_id (all, if fewer): a bounded sample, alike under any
    partitioning. residual = 1 - |z|^2 is what the features miss of a row's kernel with itself, and bounds every entry:
    |K(x, y) - z(x)z(y)| <= sqrt(residual(x) * residual(y)). It is 0 (but for rounding) at the landmarks. Rows with null features are
    no landmarks and keep null features and a null residual; repeated rows lower the number of features. No training row
    with features: ValueError.
    """
    usable = train.filter("features is not null")
    drawn = usable.select("sample_id", "features").orderBy(F.xxhash64(F.lit(seed), "sample_id"), "sample_id", "features").limit(landmarks)
    marks = np.array([row["features"] for row in drawn.collect()], dtype=float)
    if not len(marks):
        raise ValueError("no training row has features")
    gamma = default_gamma(usable) if gamma is None else gamma
    # Defined here, so that tasks get it by value.
    def kernel(x):
        squares = (x * x).sum(1)[:, None] + (marks * marks).sum(1)[None, :] - 2.0 * x @ marks.T
        return np.exp(-gamma * np.maximum(squares, 0.0))

    values, vectors = np.linalg.eigh(kernel(marks))
    known = values > values[-1] * 1e-10
    root = vectors[:, known] / np.sqrt(values[known])

    def mapped(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # A batch of Arrow may be large; its features and kernel rows are made a few at a time.
            for batch in (whole.iloc[i : i + ROWS_AT_ONCE] for whole in batches for i in range(0, len(whole), ROWS_AT_ONCE)):
                there = batch["features"].notna().to_numpy()
                features, residual = np.full(len(batch), None, object), np.full(len(batch), None, object)
                if there.any():
                    z = kernel(np.asarray(batch["features"][there].tolist(), dtype=float)) @ root
                    for i, row in zip(np.flatnonzero(there), z):
                        features[i] = row
                    residual[there] = np.maximum(1.0 - (z * z).sum(1), 0.0)
                yield batch.drop(columns=["features"]).assign(features=features, residual=residual)

        rest = df.drop("residual").select(*[c for c in df.columns if c not in ("features", "residual")], "features")
        return rest.mapInPandas(run, StructType([*rest.schema.fields, StructField("residual", DoubleType())]))

    return mapped(train), mapped(test)


def kernel_error(mapped: DataFrame) -> DataFrame:
    """One row (n, mean_residual, max_residual) of mapped rows; max_residual bounds the error of every kernel entry among them."""
    return mapped.agg(
        F.count("residual").alias("n"), F.avg("residual").alias("mean_residual"), F.max("residual").alias("max_residual")
    )
