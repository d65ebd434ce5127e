"""Bootstrap sums by hierarchical multinomials.

Drawing n rows of a stratum with replacement is a multinomial draw of weights. It is made in two steps that need no row to travel:
per iteration the stratum's n draws are split over buckets of rows by the buckets' sizes, then every bucket draws the weights of its own
rows and hands on weighted sums only. A bucket's rows are fixed by a hash of their key and seeds by stratum, bucket and iterations, so
the result is the same under every partitioning and after a lost executor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeframe.operators.settle import settled

# Rows of a bucket on average, iterations handled together, weights held at once.
ROWS = 16_384
CHUNK = 250
_HELD = 1 << 22
_WORD = 2**64


def _rng(seed: int, *parts: int) -> np.random.Generator:
    return np.random.default_rng([seed % _WORD, *[int(p) % _WORD for p in parts]])


def _split(iterations: int, seed: int):
    """Bucket sizes of one stratum to (stratum, bucket, counts): how many of the draws of each iteration of a chunk fall into each bucket."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("bucket")
        stratum, chunk = group.column("stratum")[0].as_py(), group.column("chunk")[0].as_py()
        sizes = group.column("size").to_numpy()
        rounds = min(CHUNK, iterations - chunk * CHUNK)
        counts = _rng(seed, stratum, chunk).multinomial(int(sizes.sum()), sizes / sizes.sum(), rounds)
        return pa.table(
            {
                "stratum": group.column("stratum"),
                "bucket": group.column("bucket"),
                "chunk": group.column("chunk"),
                "counts": pa.array(counts.T.tolist(), pa.list_(pa.int64())),
            }
        )

    return run


def _weighted(columns: list[str], seed: int):
    """Rows of one bucket and its counts to (chunk, stratum, bucket, sums): weighted sums of the columns per iteration."""

    def run(rows: pa.Table, counts: pa.Table) -> pa.Table:
        rows = rows.sort_by([("order", "ascending"), *[(c, "ascending") for c in columns]])
        values = np.stack([rows.column(c).to_numpy() for c in columns], axis=1).astype(float)
        share = np.full(len(values), 1.0 / max(len(values), 1))
        out = []
        for stratum, bucket, chunk, drawn in zip(*[counts.column(c).to_pylist() for c in ("stratum", "bucket", "chunk", "counts")]):
            rng, sums = _rng(seed, stratum, bucket, chunk), []
            step = max(1, _HELD // len(values))
            for lo in range(0, len(drawn), step):
                sums.append(rng.multinomial(np.array(drawn[lo : lo + step]), share) @ values)
            out.append((chunk, stratum, bucket, np.concatenate(sums).tobytes()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.table([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=["chunk", "stratum", "bucket", "sums"])

    return run


def _added(columns: list[str]):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("stratum", "ascending"), ("bucket", "ascending")])
        total = sum(np.frombuffer(raw).reshape(-1, len(columns)) for raw in group.column("sums").to_pylist())
        first = group.column("chunk")[0].as_py() * CHUNK
        return pa.table([pa.array(np.arange(first, first + len(total))), *[pa.array(total[:, i]) for i in range(len(columns))]], names=["iteration", *columns])

    return run


def resampled_sums(df: DataFrame, stratum: str | None, order: str, columns: list[str], iterations: int, seed: int, rows: int = ROWS) -> DataFrame:
    """(iteration, columns...): the sums of `columns` over each resample of the rows, drawn with replacement within each stratum.

    `order` is the key of a row; rows that share one stay in one bucket. Columns are taken as doubles; null values count as 0. An
    empty table gives no iteration.
    """
    own = F.xxhash64(F.lit(0) if stratum is None else F.col(stratum))
    data = df.select(own.alias("stratum"), F.col(order).alias("order"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    sizes = data.groupBy("stratum").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).alias("buckets"))
    data = settled(data.join(sizes, "stratum").withColumn("bucket", F.pmod(F.xxhash64("order"), F.col("buckets"))).drop("buckets"))
    chunks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((iterations - 1) // CHUNK).cast("bigint")))
    full = data.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("size")).withColumn("chunk", chunks)
    counts = full.groupBy("stratum", "chunk").applyInArrow(_split(iterations, seed), "stratum bigint, bucket bigint, chunk bigint, counts array<bigint>")
    drawn = data.groupBy("stratum", "bucket").cogroup(counts.groupBy("stratum", "bucket")).applyInArrow(
        _weighted(columns, seed), "chunk bigint, stratum bigint, bucket bigint, sums binary"
    )
    return drawn.groupBy("chunk").applyInArrow(_added(columns), ", ".join(["iteration bigint", *[f"`{c}` double" for c in columns]]))


_MOMENTS = ["n", "u", "v", "uu", "uv"]


def resampled_lines(df: DataFrame, x: str, y: str, stratum: str, order: str, iterations: int, seed: int) -> DataFrame:
    """(iteration, slope, intercept) of the least-squares line of each resample within strata; null where x is constant."""
    used = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    # Sums of values near their means lose no digits.
    middle = used.agg(F.coalesce(F.avg(x), F.lit(0.0)).alias("x"), F.coalesce(F.avg(y), F.lit(0.0)).alias("y")).first()
    u, v = F.col(x).cast("double") - float(middle["x"]), F.col(y).cast("double") - float(middle["y"])
    rows = used.select(
        F.col(stratum).alias("stratum"), F.col(order).alias("order"), F.lit(1.0).alias("n"), u.alias("u"), v.alias("v"), (u * u).alias("uu"), (u * v).alias("uv")
    )
    return _lines(resampled_sums(rows, "stratum", "order", _MOMENTS, iterations, seed), middle)


def _lines(sums: DataFrame, middle) -> DataFrame:
    """(iteration, slope, intercept) from sums of values near their means."""
    drawn = F.nullif(F.col("n"), F.lit(0.0))
    wide = F.col("n") * F.col("uu") - F.col("u") * F.col("u")
    slope = F.when(wide > 1e-12 * F.col("n") * F.col("uu"), (F.col("n") * F.col("uv") - F.col("u") * F.col("v")) / wide)
    out = sums.withColumn("slope", slope)
    intercept = F.lit(float(middle["y"])) + F.col("v") / drawn - F.col("slope") * (F.lit(float(middle["x"])) + F.col("u") / drawn)
    return out.select("iteration", "slope", intercept.alias("intercept"))


# Slots whose hashes one row stands for.
SLOTS = 32_768


def _dealt(seed: int, rows: int):
    """(stratum, size, iteration, first, last) to (stratum, bucket, chunk, iteration, picks): the draws of these slots, by the bucket of the row they pick."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text = f"{seed}|{row['iteration']}|{row['stratum']}|".encode()
                digests = b"".join([hashlib.sha1(text + b"%d" % slot).digest()[:4] for slot in range(row["first"], row["last"])])
                picks = np.sort(np.frombuffer(digests, ">u4").astype(np.int64) % row["size"])
                buckets, starts = np.unique(picks // rows, return_index=True)
                parts = [(part - bucket * rows).astype("<i4").tobytes() for bucket, part in zip(buckets, np.split(picks, starts[1:]))]
                count = len(parts)
                yield pa.RecordBatch.from_pydict(
                    {
                        "stratum": pa.array([row["stratum"]] * count, pa.string()),
                        "bucket": pa.array(buckets, pa.int64()),
                        "chunk": pa.array([row["iteration"] // CHUNK] * count, pa.int64()),
                        "iteration": pa.array([row["iteration"]] * count, pa.int64()),
                        "picks": pa.array(parts, pa.binary()),
                    }
                )

    return run


def _picked(columns: list[str]):
    """Rows of one bucket and the draws that pick them to sums of the columns per iteration."""

    def run(rows: pa.Table, draws: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        place = rows.column("place").to_numpy()
        values = np.stack([rows.column(c).to_numpy() for c in columns], axis=1)
        drawn: dict[int, np.ndarray] = {}
        for iteration, raw in zip(draws.column("iteration").to_pylist(), draws.column("picks").to_pylist()):
            weights = np.bincount(np.frombuffer(raw, "<i4"), minlength=int(place.max(initial=-1)) + 1)
            drawn[iteration] = drawn[iteration] + weights if iteration in drawn else weights
        order = sorted(drawn)
        sums = np.array([drawn[i][place] @ values for i in order]).reshape(len(order), len(columns))
        return pa.table([pa.array(order, pa.int64()), *[pa.array(sums[:, k]) for k in range(len(columns))]], names=["iteration", *columns])

    return run


def hashed_lines(ranked: DataFrame, sizes: DataFrame, iterations: int, seed: int, rows: int = ROWS, slots: int = SLOTS) -> DataFrame:
    """(iteration, slope, intercept) of resamples whose draw (iteration, stratum, slot) is the row numbered sha1 mod n of its stratum.

    `ranked` (stratum, pick, x, y), `sizes` (stratum, size). Draws go to buckets of rows as packed numbers, so a draw costs four bytes and
    no joined row; a task holds one bucket and its draws of at most `CHUNK` iterations. Rows without x or y weigh nothing.
    """
    spark = ranked.sparkSession
    used = F.col("x").isNotNull() & F.col("y").isNotNull()
    ranked = settled(ranked)
    middle = ranked.filter(used).agg(F.coalesce(F.avg("x"), F.lit(0.0)).alias("x"), F.coalesce(F.avg("y"), F.lit(0.0)).alias("y")).first()
    u, v = F.col("x") - float(middle["x"]), F.col("y") - float(middle["y"])
    moments = dict(zip(_MOMENTS, (F.lit(1.0), u, v, u * u, u * v)))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n))
    values = ranked.select(
        "stratum", F.floor(F.col("pick") / rows).alias("bucket"), (F.col("pick") % rows).alias("place"), *[F.when(used, c).otherwise(0.0).alias(n) for n, c in moments.items()]
    ).withColumn("chunk", upto(F.lit((iterations - 1) // CHUNK).cast("bigint")))
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = sizes.withColumn("iteration", upto(F.lit(iterations - 1).cast("bigint"))).withColumn("_block", upto(F.floor((F.col("size") - 1) / slots)))
    blocks = blocks.withColumn("first", F.col("_block") * slots)
    # A given number of partitions is kept: these few short rows stand for all the work.
    blocks = blocks.withColumn("last", F.least("size", F.col("first") + slots)).select("stratum", "size", "iteration", "first", "last").repartition(parts, "stratum", "iteration", "first")
    draws = blocks.mapInArrow(_dealt(seed, rows), "stratum string, bucket bigint, chunk bigint, iteration bigint, picks binary")
    keys = ["stratum", "bucket", "chunk"]
    sums = values.groupBy(*keys).cogroup(draws.groupBy(*keys)).applyInArrow(_picked(_MOMENTS), ", ".join(["iteration bigint", *[f"{c} double" for c in _MOMENTS]]))
    return _lines(sums.groupBy("iteration").agg(*[F.sum(c).alias(c) for c in _MOMENTS]), middle)
