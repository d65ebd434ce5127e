"""Exact top-k inner products by a pivot-distance index.

Vectors x get one more component sqrt(M - |x|^2), M the largest squared norm, so that all lie on one sphere; queries get 0 there.
Then |q - x|^2 = |q|^2 + M - 2 <q, x>: the best inner products are the nearest points. Every vector is keyed by its
nearest pivot and its distance to it, cut into annuli. By the triangle inequality an annulus [lo, hi] around a pivot at
distance d of the query holds nothing nearer than max(lo - d, d - hi), so nothing of a larger score than
(|q|^2 + M - that^2) / 2. A query takes its annuli in the order of that bound, in rounds that widen, and stops
when the bound is below its k-th score so far.

Both sides travel as blocks of bounded size that meet by an equi-join on (pivot, annulus); neither is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fringeframe.operators.settle import settled

PIVOTS = 32
ANNULI = 16
BLOCK = 2_048
QUERY_BLOCK = 256
ROUNDS = (1, 8)
# Integers up to here are exact in double precision, and so are the products of vectors below.
_EXACT = 2.0**53


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v ARRAY<BIGINT>) with floor(scale * x); rows with a null key, a null vector or a null or non-finite component are left out."""
    x = F.col(vector).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != math.inf))
    rows = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.coalesce(sound, F.lit(False)))
    return rows.select(F.col(key).cast("bigint").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("bigint")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows padded with zeros to `width`."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pa.compute.list_value_length(lists).to_numpy()
    out = np.zeros((len(lists), width), np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = lists.flatten().to_numpy()
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer a @ b.T."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < _EXACT:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


class Space:
    """Pivots (bounded in number), their squared norms and the sphere's square radius; the same on every task."""

    def __init__(self, pivots: np.ndarray, width: int, square: int):
        self.pivots, self.width, self.square = pivots.astype(float), width, float(square)
        self.norms = (self.pivots**2).sum(axis=1)
        self.lift = np.sqrt(np.maximum(self.square - self.norms, 0))
        self.step = 2 * math.sqrt(self.square) / ANNULI if square else 1.0

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(rows, pivots) distances on the sphere; queries have no last component."""
        x = x.astype(float)
        norms = (x**2).sum(axis=1)
        cross = x @ self.pivots.T
        whole = norms if query else np.full(len(x), self.square)
        if not query:
            cross = cross + np.sqrt(np.maximum(self.square - norms, 0))[:, None] * self.lift
        return np.sqrt(np.maximum(whole[:, None] + self.square - 2 * cross, 0))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """(queries, pivots * ANNULI) largest score that a vector of each cell can have, a little above for rounding."""
        d = self.distances(q, True)[:, :, None]
        lo = np.arange(ANNULI) * self.step
        hi = lo + self.step
        hi[-1] = max(hi[-1], 3 * math.sqrt(self.square))
        near = np.maximum(np.maximum(lo - d, d - hi), 0) * (1 - 1e-9) - 1e-6
        near = np.maximum(near, 0).reshape(len(q), -1)
        norms = (q.astype(float) ** 2).sum(axis=1)[:, None]
        return (norms + self.square - near**2) / 2 * (1 + 1e-9) + 1

    def cells(self, x: np.ndarray) -> np.ndarray:
        d = self.distances(x, False)
        pivot = d.argmin(axis=1)
        ring = np.minimum((d[np.arange(len(x)), pivot] / self.step).astype(np.int64), ANNULI - 1)
        return pivot * ANNULI + ring


def _keyed(space: Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = space.cells(_matrix(batch.column("v"), space.width)) if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell)], ["id", "v", "cell"])

    return run


def _blocks(df: DataFrame, cell: str, rows: int, name: str) -> DataFrame:
    """Rows of a cell in blocks of about `rows`, cut by the hash of their id: a full cell is many blocks."""
    sizes = df.groupBy(cell).agg(F.ceil(F.count(F.lit(1)) / rows).cast("bigint").alias("_n"))
    cut = df.join(sizes, cell).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_n")))
    return cut.groupBy(cell, "_b").agg(F.collect_list(F.struct(*[c for c in df.columns if c != cell])).alias(name)).drop("_b")


def top_k(
    df: DataFrame,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
    is_query: str = "id % 50 = 0",
    pivots: int = PIVOTS,
    rounds: tuple[int, ...] = ROUNDS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query with the vectors of other ids.

    Components are floor(scale * x); scores are exact while they fit a BIGINT. Queries are the rows for which `is_query` (on `id`) holds.
    Ties go to the smaller id; fewer than k candidates give fewer rows. Rows with a null id, or a vector that is
    null or has a null or non-finite component, take no part; shorter vectors count as padded with zeros. A repeated id is a candidate
    of other queries once per row and queries once, with its smallest vector. `rounds` are the numbers of annuli after which scores
    are compared with bounds; one last round takes all that is left.
    """
    spark = df.sparkSession
    data = integer_vectors(df, key, vector, scale)
    square = F.aggregate("v", F.lit(0).cast("double"), lambda s, c: s + c.cast("double") * c)
    width, top, n = data.agg(F.max(F.size("v")), F.max(square), F.count(F.lit(1))).first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if not n:
        return empty
    width = max(width, 1)
    chosen = data.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    space = Space(_matrix(pa.array([r["v"] for r in chosen], pa.list_(pa.int64())), width), width, top)
    keyed = settled(data.mapInArrow(_keyed(space), "id bigint, v array<bigint>, cell bigint"))
    index = settled(_blocks(keyed, "cell", BLOCK, "xs"))
    asked = keyed.filter(is_query).groupBy("id").agg(F.min(F.struct("v", "cell")).alias("q")).select("id", "q.v", "q.cell")
    # Each query with its k-th score so far (null: fewer than k seen) and the number of cells it has taken.
    queries = settled(asked.withColumn("kth", F.lit(None).cast("bigint")).withColumn("taken", F.lit(0)))
    best = None
    cells = len(chosen) * ANNULI
    for upto in [*[r for r in rounds if r < cells], cells]:
        found = _searched(queries, index, space, k, upto)
        both = found if best is None else best.unionByName(found)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = settled(both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "vec_id", "score"))
        if upto < cells:
            kth = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
            queries = queries.drop("kth", "taken").join(kth.withColumnRenamed("query_id", "id"), "id", "left").withColumn("taken", F.lit(upto))
            queries = settled(queries)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")


def _searched(queries: DataFrame, index: DataFrame, space: Space, k: int, upto: int) -> DataFrame:
    """(query_id, vec_id, score): per query and block its best k among the cells from `taken` to `upto` in the order of their bounds."""

    def open_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), QUERY_BLOCK):
                part = batch.slice(lo, QUERY_BLOCK)
                bounds = space.bounds(_matrix(part.column("v"), space.width))
                order = np.argsort(-bounds, axis=1, kind="stable")
                kth = part.column("kth").to_pylist()
                taken = part.column("taken").to_pylist()
                who, cell = [], []
                for i in range(len(part)):
                    own = order[i, taken[i] : upto]
                    if kth[i] is not None:
                        own = own[bounds[i, own] >= kth[i]]
                    who.append(np.full(len(own), i))
                    cell.append(own)
                at = pa.array(np.concatenate(who))
                yield pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("v").take(at), pa.array(np.concatenate(cell))], ["id", "v", "cell"])

    asked = queries.mapInArrow(open_cells, "id bigint, v array<bigint>, cell bigint")
    meeting = _blocks(asked, "cell", QUERY_BLOCK, "qs").join(index, "cell")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                qs, xs = (batch.column(c)[i].values for c in ("qs", "xs"))
                qid, xid = qs.field("id").to_numpy(), xs.field("id").to_numpy()
                s = _products(_matrix(qs.field("v"), space.width), _matrix(xs.field("v"), space.width))
                # Candidates in id order, so that a stable sort by score breaks ties to the smaller id.
                order = np.argsort(xid, kind="stable")
                xid, s = xid[order], s[:, order]
                out = []
                for j in range(len(qid)):
                    own = np.flatnonzero(xid != qid[j])
                    row = s[j, own]
                    if len(own) > k:
                        cut = np.partition(row, len(row) - k)[len(row) - k]
                        own, row = own[row >= cut], row[row >= cut]
                    place = np.argsort(-row, kind="stable")[:k]
                    out.append((np.full(len(place), qid[j]), xid[own[place]], row[place]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "vec_id", "score"])

    return meeting.select("qs", "xs").mapInArrow(score, "query_id bigint, vec_id bigint, score bigint")
