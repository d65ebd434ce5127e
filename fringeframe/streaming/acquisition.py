"""Acquisition as streams: landed frames, scan progress, retries, completeness, field quantification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fringeframe.operators.calibrate import estimate
from fringeframe.operators.ml import score_linear
from fringeframe.operators.settle import scratch

FRAME_SCHEMA = (
    "scan_id bigint, position bigint, ts timestamp, bytes bigint, attempts bigint, capture_seconds double"
)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def landed_frames(spark: SparkSession, path: str, schema: str = FRAME_SCHEMA, glob: str = "*.json") -> DataFrame:
    """Stream of committed frame records: folders ending in .partial and files ending in .part are not read."""
    raw = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).json(path)
    return raw.filter(~F.col("_metadata.file_path").contains(".partial/"))


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything there is, then stop. The checkpoint lies in the cluster's shared folder."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(sink)
        .option("checkpointLocation", scratch(stream.sparkSession, "stream"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def versioned_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Write each batch's rows to its own folder; repeating a batch overwrites it, so retries add nothing."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Newest version of each key written by `versioned_sink`."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c not in ("batch", key)]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("_r"))
    return newest.select(key, "_r.*")


def scan_progress(frames: DataFrame, total: int) -> DataFrame:
    """Running totals per scan; update mode emits only scans that moved."""
    return frames.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("completed_frames"),
        F.sum("bytes").alias("total_bytes"),
        F.sum("attempts").alias("attempts"),
        F.sum("capture_seconds").alias("capture_seconds"),
        F.when(F.count(F.lit(1)) >= total, "complete").otherwise("scanning").alias("status"),
    )


def without_retries(frames: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First record of each (scan, position) within the watermark."""
    return frames.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["scan_id", "position"])


class Completeness(StatefulProcessor):
    """Positions seen per scan as a bit set; ends a scan when all are there or its time is up."""

    def __init__(self, total: int, init: int, step: int, timeout_ms: int):
        self.total, self.first, self.step, self.timeout_ms = total, init, step, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "bits string, done boolean")

    def _row(self, scan: int, status: str, bits: int) -> pd.DataFrame:
        gaps = [self.first + self.step * (i + 1) for i in range(self.total) if not bits >> i & 1]
        return pd.DataFrame(
            {
                "scan_id": [scan],
                "status": [status],
                "completed": [self.total - len(gaps)],
                "missing": [",".join(map(str, gaps))],
            }
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.seen.exists()
        text, done = self.seen.get() if known else ("0", False)
        bits, earliest = int(text, 16), None
        for batch in rows:
            slot = (batch["position"] - self.first) // self.step - 1
            fits = ((batch["position"] - self.first) % self.step == 0) & slot.between(0, self.total - 1)
            for i in set(slot[fits].tolist()):
                bits |= 1 << int(i)
            start = batch["ts"].min()
            earliest = start if earliest is None else min(earliest, start)
        if not known and earliest is not None:
            self.handle.registerTimer(int(earliest.timestamp() * 1000) + self.timeout_ms)
        full = bits == (1 << self.total) - 1
        self.seen.update((format(bits, "x"), bool(done or full)))
        if full and not done:
            yield self._row(key[0], "complete", bits)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        text, done = self.seen.get() if self.seen.exists() else ("0", True)
        self.seen.clear()
        if not done:
            yield self._row(key[0], "failed", int(text, 16))

    def close(self) -> None:
        pass


def completeness(frames: DataFrame, total: int, init: int, step: int, timeout_ms: int, delay: str = "1 minute") -> DataFrame:
    """(scan_id, status, completed, missing): `complete` once all expected positions arrived, else `failed`
    with the missing positions when event time passes the first frame by `timeout_ms`. State per scan is
    one bit per expected position. Needs the RocksDB state store, which is set on the session here."""
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return (
        frames.select("scan_id", "position", "ts")
        .withWatermark("ts", delay)
        .groupBy("scan_id")
        .transformWithStateInPandas(
            Completeness(total, init, step, timeout_ms),
            "scan_id bigint, status string, completed bigint, missing string",
            "Append",
            "EventTime",
        )
    )


def field_quantities(detections: DataFrame, model: DataFrame, labels: list[str]) -> DataFrame:
    """Running class counts per field of a stream with `features`, classified by a stored linear model."""
    scored = score_linear(detections, model)
    names = F.array(*[F.lit(l) for l in labels])
    label = names[F.col("predicted_index").cast("int")]
    return scored.groupBy("field_id").agg(
        F.count(F.lit(1)).alias("total_count"), *[F.count_if(label == l).alias(f"count_{l}") for l in labels]
    )


def quantified(counts: DataFrame, labels: list[str], slope: float, intercept: float) -> DataFrame:
    """Latest counts to concentrations, one row per field and label plus the field total."""
    pairs = F.array(*[F.struct(F.lit(l).alias("label"), F.col(f"count_{l}").alias("count")) for l in labels])
    rows = counts.select("field_id", "total_count", F.explode(pairs).alias("p")).select("field_id", "total_count", "p.*")
    return rows.withColumn("concentration", estimate(F.col("count"), slope, intercept)).withColumn(
        "total_concentration", estimate(F.col("total_count"), slope, intercept)
    )
