"""Connected components, and Arrow batches small enough for long texts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fringeframe.operators.settle import settled

# Edges that one task holds at once (16 bytes each, about 100 with its sorted nodes).
TASK_EDGES = 1_000_000


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Fewer rows per Arrow batch for the jobs that run inside, as rows hold whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    with _setting(spark, name, str(min(rows, before) if before > 0 else rows)):
        yield


@contextmanager
def joins_by_shuffle(spark: SparkSession) -> Iterator[None]:
    """No join that runs inside passes a table through the driver: dozens of such broadcasts a minute fill its memory."""
    with _setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        yield


def _observed(df: DataFrame, **facts: Column) -> tuple[DataFrame, dict]:
    """`df` settled, and aggregates of its rows taken while it is written: they need no job of their own."""
    seen = Observation()
    own = settled(df.observe(seen, *[c.alias(k) for k, c in facts.items()]))
    return own, seen.get


def compact(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Computed once, then read by about one task per `rows` rows: short tables don't make a shuffle file per partition."""
    own, facts = _observed(df, n=F.count(F.lit(1)))
    return own.coalesce(max(1, -(-facts["n"] // rows)))


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted nodes of the edges a - b, smallest node that each reaches by them).

    Roots hook under the smallest root next to them, then pointers are halved: of each component at least half the roots go a round.
    """
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while len(u):
        lo, hi = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        apart = lo < hi
        u, v = u[apart], v[apart]
        np.minimum.at(root, hi[apart], lo[apart])
        while not np.array_equal(above := root[root], root):
            root = above
    return nodes, nodes[root]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a task as stars: each node with the smallest one it reaches within the task, roots with themselves."""
    parts = [(batch.column("u").to_numpy(), batch.column("v").to_numpy()) for batch in batches]
    if parts:
        nodes, roots = smallest_reachable(*(np.concatenate(side) for side in zip(*parts)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["u", "v"])


def components(edges: DataFrame, max_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component) of all nodes of `edges` (a, b): component is the smallest node that can be reached.

    Every task first turns up to `task_edges` edges, dealt evenly so that no hub makes a large task, into stars. If the stars fit one
    such task, they are merged there. Otherwise alternating large-star and small-star rounds follow: each is one aggregate and one
    equi-join over the edges, their number grows with the logarithm of the nodes, and no group is ever collected. Rounds are cut
    by reliable checkpoints. Edges of a node with itself are left out.
    """
    shape = "u bigint, v bigint"
    plain = edges.select(F.col("a").cast("bigint").alias("u"), F.col("b").cast("bigint").alias("v")).filter("u <> v")
    at, facts = _observed(plain, n=F.count(F.lit(1)))
    while facts["n"] > task_edges:
        before = facts["n"]
        dealt = at.repartition(-(-before // task_edges))
        at, facts = _observed(dealt.mapInArrow(_contracted, shape).filter("u <> v"), n=F.count(F.lit(1)))
        if facts["n"] * 2 > before:
            break
    if facts["n"] <= task_edges:
        found = at.coalesce(1).mapInArrow(_contracted, shape)
        return settled(found.select(F.col("u").alias("node"), F.col("v").alias("component")))
    return _star_rounds(at, max_rounds)


def _star_rounds(edges: DataFrame, max_rounds: int) -> DataFrame:
    at = compact(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    known = None
    for _ in range(max_rounds):
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star over the result: every neighbour not above a node, and the node, go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        own, shape = _observed(
            small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(),
            n=F.count(F.lit(1)),
            hash=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
        )
        at = own.coalesce(max(1, -(-shape["n"] // 100_000)))
        if shape == known:
            return at.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        known = shape
    raise RuntimeError("components did not settle")
