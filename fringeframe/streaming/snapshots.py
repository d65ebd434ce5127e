"""A compacted table of the newest row per key, kept by update-mode streams.

Keys are dealt to a fixed number of hash buckets. A batch rewrites only the buckets its keys fall into, each as one folder of a new
version, and then swaps one small manifest that names the version of every bucket. Readers follow the newest manifest, so they see
whole batches or nothing of them. Folders that no manifest in use names are deleted, so the number of files does not grow with the
number of batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "snapshot_bucket"


def _store(spark: SparkSession, path: str):
    """File system of a path and a maker of its paths; any store that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _manifests(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the manifests there are, ascending; a file still being written has another ending."""
    store, at = _store(spark, path)
    folder = at(f"{path}/_manifests")
    names = [s.getPath().getName() for s in store.listStatus(folder)] if store.exists(folder) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def _manifest(spark: SparkSession, path: str, number: int) -> dict:
    lines = spark.read.text(f"{path}/_manifests/{number:012d}.json", wholetext=True).first()
    return json.loads(lines[0])


def _commit(spark: SparkSession, path: str, number: int, manifest: dict) -> None:
    """Make a manifest visible by one rename."""
    store, at = _store(spark, path)
    final, part = at(f"{path}/_manifests/{number:012d}.json"), at(f"{path}/_manifests/{number:012d}.part")
    out = store.create(part, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if not store.rename(part, final):
        raise RuntimeError(f"version {number} of {path} was committed by another writer")


def _clean(spark: SparkSession, path: str, number: int, manifest: dict) -> None:
    """Delete what only manifests before the previous one name; a reader of the previous one may still be at work."""
    store, at = _store(spark, path)
    for bucket, version in manifest["expired"]:
        store.delete(at(f"{path}/v={version}/{BUCKET}={bucket}"), True)
        folder = at(f"{path}/v={version}")
        if store.exists(folder) and not any(s.isDirectory() for s in store.listStatus(folder)):
            store.delete(folder, True)
    for old in _manifests(spark, path):
        if old < number - 1:
            store.delete(at(f"{path}/_manifests/{old:012d}.json"), False)


def _rows(spark: SparkSession, path: str, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
    folders = [f"{path}/v={v}/{BUCKET}={b}" for b, v in manifest["buckets"].items() if buckets is None or int(b) in buckets]
    schema = StructType.fromJson(manifest["schema"])
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def keyed_sink(path: str, key: str, stream: str = "stream", buckets: int = 32) -> Callable[[DataFrame, int], None]:
    """Keep the newest row of each key at `path`, for `foreachBatch` of an update-mode stream.

    `stream` names the query with its checkpoint: a batch whose number this query has committed already is skipped, so a repeated batch
    changes nothing; a query with a new checkpoint needs a new name. Of several rows of a key in one batch the largest by the
    other columns counts. A null key is a key. Empty batches write nothing once the table exists. One writer at a time.

    A batch is compared with the buckets it touches, which are read and written in tasks of one bucket each; choose `buckets` so that
    one bucket of the whole table fits a task. The number is fixed by the first batch. What the driver holds is one number per bucket.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = _manifests(spark, path)
        number = known[-1] if known else -1
        old = _manifest(spark, path, number) if known else {"buckets": {}, "streams": {}, "count": buckets, "expired": [], "replaced": []}
        if old["streams"].get(stream, -1) >= batch_id:
            _clean(spark, path, number, old)
            return
        rest = [c for c in batch.columns if c != key]
        if BUCKET in batch.columns:
            raise ValueError(f"a column may not be named {BUCKET}")
        newest = batch.groupBy(key).agg(F.max(F.struct(*rest)).alias("_r")).select(key, "_r.*") if rest else batch.distinct()
        rows = newest.select(*batch.columns)
        place = F.pmod(F.xxhash64(F.col(key)), F.lit(old["count"])).cast("int")
        batch.persist()
        try:
            touched = sorted(r[0] for r in rows.select(place.alias("b")).distinct().collect())
            if touched or not known:
                if known:
                    before = _rows(spark, path, old, touched)
                    kept = before.alias("o").join(rows.select(F.col(key).alias("_key")), F.col(f"o.{key}").eqNullSafe(F.col("_key")), "left_anti")
                    rows = kept.unionByName(rows)
                dealt = rows.withColumn(BUCKET, place).repartition(max(1, len(touched)), BUCKET)
                dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/v={number + 1}")
        finally:
            batch.unpersist()
        replaced = [[b, old["buckets"][str(b)]] for b in touched if str(b) in old["buckets"]]
        new = {
            "buckets": old["buckets"] | {str(b): number + 1 for b in touched},
            "streams": old["streams"] | {stream: batch_id},
            "schema": json.loads(batch.schema.json()) if not known else old["schema"],
            "count": old["count"],
            "replaced": replaced,
            "expired": old["replaced"],
        }
        _commit(spark, path, number + 1, new)
        _clean(spark, path, number + 1, new)

    return write


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Newest row of each key as of the last committed batch. Fails where no batch was ever committed."""
    known = _manifests(spark, path)
    if not known:
        raise ValueError(f"no committed batch at {path}")
    return _rows(spark, path, _manifest(spark, path, known[-1]))
