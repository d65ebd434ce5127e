"""Whitening of embeddings with a polarisation covariance.

Cov(a, b) = (Var(a + b) - Var(a) - Var(b)) / 2: one aggregate of squares for every dimension and for the sum of every pair of dimensions
holds the whole covariance. Components are integers, so all of it is exact: values are centred on the integer next to their mean
before squaring, and the rest of the mean, a fraction of n, is taken off in whole numbers at the end. Only FOLDS rows of
d + d(d-1)/2 sums reach the driver, where the d x d matrix goes to eigh.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeframe.llm.vectors import _matrix
from fringeframe.operators.settle import settled

_SAFE = 2.0**62
# Values of pair sums that are squared at once.
_STEP = 1 << 20
FOLDS = 32
OUTPUT = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def integer_rows(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(key, x ARRAY<BIGINT>) with floor(scale * c) of every row whose vector is not null and has only finite components."""
    c = F.col(vector).cast("array<double>")
    sound = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != math.inf))
    return df.filter(F.col(vector).isNotNull() & F.coalesce(sound, F.lit(False))).select(
        F.col(key), F.transform(c, lambda v: F.floor(v * scale).cast("bigint")).alias("x")
    )


def _totals(fit: DataFrame, values, width: int, places: int, kind: type = int) -> list:
    """Number of rows, then the sums of `values(block of rows)` per place: one row of sums a task, added up in FOLDS groups of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(places, object if kind is int else float), 0
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            rows += len(x)
            for lo in range(0, len(x), max(1, _STEP // width)):
                total = total + values(x[lo : lo + max(1, _STEP // width)])
        yield _row(TaskContext.get().partitionId(), [rows, *total])

    def _row(task: int, total: list) -> pa.RecordBatch:
        text = pa.array([[repr(kind(t)) for t in total]], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), text], ["task", "total"])

    def add(parts: pa.Table) -> pa.Table:
        own = parts.sort_by("task").to_pydict()
        total = [sum(map(kind, place)) for place in zip(*own["total"])]
        return pa.Table.from_batches([_row(own["task"][0], total)])

    schema = "task int, total array<string>"
    parts = fit.mapInArrow(run, schema)
    folded = parts.groupBy(F.pmod("task", F.lit(FOLDS)).alias("fold")).applyInArrow(add, schema).collect()
    return [sum(map(kind, place)) for place in zip(*[r["total"] for r in sorted(folded)])] or [kind(0)] * (places + 1)


def _square_sums(y: np.ndarray) -> np.ndarray:
    """Exact sums of the squares of the columns."""
    top = float(np.abs(y).max(initial=0))
    if top * top * max(len(y), 1) < _SAFE:
        return np.einsum("ij,ij->j", y, y).astype(object)
    wide = y.astype(object)
    return (wide * wide).sum(axis=0)


def _polarised(middle: np.ndarray):
    """Squares of every centred dimension, then of the sums of the pairs (0, 1), (0, 2), ..., (1, 2), ..."""

    def values(x: np.ndarray) -> np.ndarray:
        y = x - middle
        return np.concatenate([_square_sums(y), *[_square_sums(y[:, a : a + 1] + y[:, a + 1 :]) for a in range(y.shape[1] - 1)]])

    return values


def covariance(n: int, rest: list[int], squares: list[int]) -> tuple[np.ndarray, float]:
    """(V, trace): covariance with divisor n from the squares of values centred on integers; `rest` is n times what is left of each mean.

    With u = n * y - rest summing to zero, the sum of u^2 is n^2 * (sum of y^2) - n * rest^2, for a pair with the sum of both rests.
    """
    d = len(rest)
    own = [n * n * squares[a] - n * rest[a] ** 2 for a in range(d)]
    v = np.zeros((d, d))
    at = d
    for a in range(d):
        v[a, a] = own[a] / n**3
        for b in range(a + 1, d):
            pair = n * n * squares[at] - n * (rest[a] + rest[b]) ** 2
            v[a, b] = v[b, a] = (pair - own[a] - own[b]) / (2 * n**3)
            at += 1
    return v, sum(own) / n**3


class Whitener:
    """Centre and the scaled eigenvectors; d x d numbers at most."""

    def __init__(self, n: int, middle: np.ndarray, rest: np.ndarray, axes: np.ndarray, values: np.ndarray):
        self.n, self.middle, self.rest, self.scaled = n, middle, rest, axes / np.sqrt(values)

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.middle) - self.rest / self.n) @ self.scaled

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)^2; None where it does not fit a BIGINT."""
        y = x - self.middle
        about = ((y.astype(float) * self.n - self.rest) ** 2).sum(axis=1)
        if about.max(initial=0) < _SAFE:
            u = y * self.n - self.rest
            return np.einsum("ij,ij->i", u, u).tolist()
        u = y.astype(object) * self.n - np.array([int(r) for r in self.rest], object)
        return [int(s) if s < 2**63 else None for s in (u * u).sum(axis=1)]


def _identity_error(fit: DataFrame, whitener: Whitener, width: int) -> float:
    """Largest entry of |covariance of the whitened fit list - identity|: means first, then products of centred values."""
    k, n = whitener.scaled.shape[1], whitener.n

    def pass_over(values, places: int) -> np.ndarray:
        return np.array(_totals(fit, lambda x: values(whitener.project(x)), width, places, float)[1:])

    mean = pass_over(lambda w: w.sum(axis=0), k) / n
    products = pass_over(lambda w: ((w - mean).T @ (w - mean)).ravel(), k * k).reshape(k, k) / n
    return float(np.abs(products - np.eye(k)).max())


def whiten(df: DataFrame, components: int = 4, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every sound row and each of the first components.

    x = floor(scale * c); the fit list is every distinct x vector once: n vectors with the sums S. Components are the unit
    eigenvectors of its covariance (divisor n) by falling eigenvalue, from 1; whitened is x - S / n on them over the root of the
    eigenvalue, explained the eigenvalue's share of the trace, deviation the exact sum of (n * x - S)^2 (null where it does not fit
    a BIGINT), identity_error how far the whitened fit list is from unit covariance.

    Rows whose vector is null or holds a null or non-finite component are left out; a null key stays; rows that repeat a key or a vector
    give their own result rows. Shorter vectors count as padded with zeros. A component without variance (constant or fewer than two
    distinct vectors, too few dimensions) gives no row, so a table of equal vectors, like an empty one, gives none. The sign of a
    component is free but the same for all rows, and so is the choice among equal eigenvalues. Other columns of `df` are not read.
    """
    kind = df.schema[key].dataType.simpleString()
    output = f"`{key}` {kind}, {OUTPUT}"
    rows = integer_rows(df, key, vector, scale)
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    missing = F.lit(width) - F.size("x")
    rows = rows.withColumn("x", F.when(missing > 0, F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), missing))).otherwise(F.col("x")))
    empty = df.sparkSession.createDataFrame([], output)
    if not width:
        return empty
    fit = settled(rows.select("x").distinct())
    n, *sums = _totals(fit, lambda x: x.astype(object).sum(axis=0) if np.abs(x).max(initial=0) > 2**31 else x.sum(axis=0).astype(object), width, width)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, centre)]
    middle = np.array(centre, np.int64)
    _, *squares = _totals(fit, _polarised(middle), width, width + width * (width - 1) // 2)
    v, trace = covariance(n, rest, squares)
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[: min(components, width)]
    order = order[values[order] > 0]
    order = order[values[order] > width * np.finfo(float).eps * max(values[-1], 0) * 8]
    if not len(order):
        return empty
    whitener = Whitener(n, middle, np.array(rest, np.int64), axes[:, order], values[order])
    error = _identity_error(fit, whitener, width)
    shares, k = values[order] / trace, len(order)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            m = len(x)
            columns = [
                batch.column(key).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)),
                pa.array(whitener.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(whitener.project(x).ravel()),
                pa.array(np.tile(shares, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(results, output)
