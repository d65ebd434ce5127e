"""Exact nearest rows by Euclidean distance in blocks, of which only those meet that can matter.

Rows go to their nearest pivot (per class where lists are kept per class), and each cell is packed into blocks of bounded size with a
centre and a radius; queries alike. Every query block first meets the block next to it that holds enough rows, which gives each
query its k-th distance so far, and the block the largest of them. Then it meets the blocks whose distance, centre to centre less
both radii, is not above that: all others hold nothing nearer. A rank limit merges the lists. Neither side is broadcast, no task
holds a whole side, and no pair of rows is handed on but the k best of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fringeframe.operators.settle import settled

BLOCK = 2048
PIVOTS = 64
# Queries of a block that meet the other block at once, and pairs measured again at once: a task's memory does not grow with full
# blocks, nor with copies, all of which lie within the slack.
QUERIES_AT_ONCE = 256
PAIRS_AT_ONCE = 1 << 14
# Slack of the bounds against rounding.
_SLACK = 1e-9
_PACKED = "cell bigint, part bigint, kind bigint, rows bigint, ids array<bigint>, classes array<bigint>, x binary, centre array<double>, radius double"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _cells(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column("features"))
                near = ((x**2).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(axis=1)).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "kind", "class", "features")], pa.array(near.astype(np.int64))], ["id", "kind", "class", "features", "cell"])

    return run


def _pack(group: pa.Table) -> pa.Table:
    group = group.sort_by("id")
    x = _matrix(group.column("features"))
    centre = x.mean(axis=0)
    radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())
    first = lambda name: group.column(name).slice(0, 1)
    return pa.table(
        {
            "cell": first("cell"),
            "part": first("part"),
            "kind": first("kind"),
            "rows": pa.array([len(group)]),
            "ids": pa.array([group.column("id").to_numpy().tolist()], pa.list_(pa.int64())),
            "classes": pa.array([group.column("class").to_pylist()], pa.list_(pa.int64())),
            "x": pa.array([x.tobytes()], pa.binary()),
            "centre": pa.array([centre.tolist()], pa.list_(pa.float64())),
            "radius": pa.array([radius]),
        }
    )


def _blocks(df: DataFrame, pivots: np.ndarray, block: int, rows: int) -> DataFrame:
    """Packed blocks (block id, kind, rows, ids, classes, x, centre, radius) of (id, kind, class, features)."""
    keyed = df.mapInArrow(_cells(pivots), "id bigint, kind bigint, class bigint, features array<double>, cell bigint")
    if rows <= block:  # no cell can be too large
        packed = keyed.withColumn("part", F.lit(0).cast("bigint")).groupBy("cell", "part", "kind").applyInArrow(_pack, _PACKED)
        return settled(packed.withColumn("block", F.xxhash64("cell", "part", "kind")))
    keyed = settled(keyed)
    sizes = keyed.groupBy("cell", "kind").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("parts"))
    cut = keyed.join(sizes, ["cell", "kind"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    packed = cut.groupBy("cell", "part", "kind").applyInArrow(_pack, _PACKED)
    return settled(packed.withColumn("block", F.xxhash64("cell", "part", "kind")))


def _distances(a: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of rows r of a to rows c of b, from their differences."""
    out = np.empty(len(r))
    for at in range(0, len(r), PAIRS_AT_ONCE):
        part = slice(at, at + PAIRS_AT_ONCE)
        gap = a[r[part]] - b[c[part]]
        out[part] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def _best(a: np.ndarray, b: np.ndarray, bb: np.ndarray, qid: np.ndarray, tid: np.ndarray, k: int, exclude_self: bool):
    """(row of a, row of b, distance, rank) of the k rows of b nearest each row of a; `bb` are the squares of b's rows."""
    aa = (a**2).sum(axis=1)
    square = aa[:, None] - 2 * a @ b.T + bb
    if exclude_self:
        square[qid[:, None] == tid] = np.inf
    # Products round, so all within the slack of the k-th are measured again from their differences.
    last = np.partition(square, min(k, len(tid)) - 1, axis=1)[:, min(k, len(tid)) - 1]
    slack = 1e-9 * (aa + bb.max())
    r, c = np.nonzero((square <= (last + slack)[:, None]) & np.isfinite(square))
    d = _distances(a, b, r, c)
    order = np.lexsort((tid[c], d, r))
    r, c, d = r[order], c[order], d[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    keep = rank < k
    return r[keep], c[keep], d[keep], rank[keep]


def _pair(batch: pa.RecordBatch, i: int, k: int, exclude_self: bool) -> pa.RecordBatch:
    qid, tid = (batch.column(c)[i].values.to_numpy() for c in ("qids", "ids"))
    cls = batch.column("classes")[i].values
    a, b = (np.frombuffer(batch.column(c)[i].as_buffer()).reshape(len(n), -1) for c, n in (("qx", qid), ("x", tid)))
    bb = (b**2).sum(axis=1)
    found = []
    for at in range(0, len(qid), QUERIES_AT_ONCE):
        part = slice(at, at + QUERIES_AT_ONCE)
        r, *rest = _best(a[part], b, bb, qid[part], tid, k, exclude_self)
        found.append((r + at, *rest))
    r, c, d, rank = (np.concatenate(column) for column in zip(*found))
    known = batch.column("known")[i].as_py()
    if known:
        # What a query has found so far: rows farther than its k-th are not handed on.
        far = {e["query_id"]: e["kth"] for e in known}
        keep = d <= np.array([far.get(q, np.inf) for q in qid.tolist()])[r] * (1 + _SLACK)
        r, c, d, rank = r[keep], c[keep], d[keep], rank[keep]
    full = np.bincount(r, minlength=len(qid)) >= k
    limit = float(d[rank == k - 1].max(initial=0)) if full.all() else float("inf")
    n = len(r)
    columns = [qid[r], tid[c], np.full(n, batch.column("kind")[i].as_py()), cls.take(pa.array(c)), d, np.full(n, batch.column("qblock")[i].as_py()), np.full(n, limit)]
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns], ["query_id", "row_id", "kind", "class_index", "distance", "qblock", "limit"])


def _met(k: int, exclude_self: bool):
    """Rows (qblock, kind, qids, qx, ids, classes, x, known) to the k best of each query in the other block, and `limit`: the largest k-th distance (infinite where one has fewer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                yield _pair(batch, i, k, exclude_self)

    return run


_MET = "query_id bigint, row_id bigint, kind bigint, class_index bigint, distance double, qblock bigint, limit double"


def search(
    rows: DataFrame, queries: DataFrame, k: int, per_class: bool = False, exclude_self: bool = False, block: int = BLOCK, pivots: int = PIVOTS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lists, visited block pairs, all block pairs); see `nearest_rows`."""
    spark = rows.sparkSession
    kind = F.col("class_index").cast("bigint") if per_class else F.lit(0).cast("bigint")
    features = F.col("features").cast("array<double>").alias("features")
    t = rows.select(F.col("sample_id").cast("bigint").alias("id"), kind.alias("kind"), F.col("class_index").cast("bigint").alias("class"), features)
    none = F.lit(0).cast("bigint")
    q = queries.select(F.col("sample_id").cast("bigint").alias("id"), none.alias("kind"), none.alias("class"), features)
    t, q = settled(t), settled(q)
    # As many cells as quarter blocks, so that short tables stay in one or two.
    counts = t.count(), q.count()
    cells = min(pivots, max(1, counts[0] * 4 // block))
    chosen = t.orderBy(F.xxhash64("id"), "id").limit(cells).collect()
    places = np.array([r["features"] for r in chosen], float) if chosen else np.zeros((1, 1))
    right, left = (
        _blocks(df, places, block, n) if chosen else spark.createDataFrame([], _PACKED + ", block bigint") for df, n in zip((t, q), counts)
    )
    # Pairs of block centres, not of rows; the join is on the pivot, so that it is spread over tasks.
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(len(places) - 1).cast("bigint"))
    asked = left.select(F.col("block").alias("qblock"), F.col("centre").alias("qc"), F.col("radius").alias("qr"), F.explode(every).alias("cell"))
    held = right.select("cell", "block", "kind", "rows", "centre", "radius")
    apart = F.sqrt(F.aggregate(F.zip_with("qc", "centre", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v))
    pairs = asked.join(held, "cell").select("qblock", "block", "kind", "rows", "qr", "radius", apart.alias("apart"))
    enough = F.col("rows") < k + (1 if exclude_self else 0)
    near = F.row_number().over(Window.partitionBy("qblock", "kind").orderBy(enough, "apart", "block"))
    first = pairs.withColumn("r", near).filter("r = 1").select("qblock", "block")
    sides = left.select(F.col("block").alias("qblock"), F.col("ids").alias("qids"), F.col("x").alias("qx")), right.select("block", "kind", "ids", "classes", "x")

    def meet(which: DataFrame) -> DataFrame:
        return which.join(sides[0], "qblock").join(sides[1], "block").select("qblock", "kind", "qids", "qx", "ids", "classes", "x", "known").mapInArrow(_met(k, exclude_self), _MET)

    entry = "array<struct<query_id: bigint, kth: double>>"
    begun = settled(meet(first.withColumn("known", F.lit(None).cast(entry))))
    limits = begun.groupBy("qblock", "kind").agg(F.max("limit").alias("limit"))
    kth = begun.groupBy("qblock", "kind", "query_id").agg(F.max("distance").alias("kth"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    known = kth.groupBy("qblock", "kind").agg(F.collect_list(F.struct("query_id", "kth")).cast(entry).alias("known"))
    bound = F.greatest(F.lit(0.0), F.col("apart") * (1 - _SLACK) - (F.col("qr") + F.col("radius")) * (1 + _SLACK))
    open_ = pairs.join(limits, ["qblock", "kind"], "left").filter(F.col("limit").isNull() | (bound <= F.col("limit") * (1 + _SLACK)))
    rest = open_.select("qblock", "block", "kind").join(first, ["qblock", "block"], "left_anti")
    met = meet(rest.join(known, ["qblock", "kind"], "left").drop("kind"))
    both = begun.unionByName(met).drop("qblock", "limit")
    keys = ["query_id", "kind"] if per_class else ["query_id"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("distance", "row_id"))
    best = both.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best, first.unionByName(rest.drop("kind")), pairs


def nearest_rows(
    rows: DataFrame,
    queries: DataFrame,
    k: int,
    per_class: bool = False,
    exclude_self: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, row_id, class_index, distance, rank) of the k nearest rows, ties by row_id.

    Both inputs have sample_id, class_index, features ARRAY<DOUBLE>. `per_class` keeps k per row class.
    """
    best, _, _ = search(rows, queries, k, per_class, exclude_self, block)
    return best.select("query_id", "row_id", "class_index", "distance", "rank")
