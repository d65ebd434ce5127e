"""Tables in and out: calibration fields, band lists, linear models, caches, exports and manifests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALIBRATION_NUMBERS = [
    "target_concentration_particles_ml",
    "hemocytometer_count_9_subsquares",
    "reference_concentration_particles_ml",
    "ring_count",
    "include_flag",
]
MANIFEST_SCHEMA = (
    "mode string, status string, runs array<struct<image: string, inference_ms: double, "
    "preprocess: struct<scale: double, pad_left: double, pad_top: double, original_width: int, original_height: int>, "
    "outputs: array<struct<file: string>>>>"
)


def coerce_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to DOUBLE where possible, NULL otherwise; NaN becomes NULL."""
    number = lambda c: F.col(c).try_cast("double")
    return df.withColumns({c: F.when(~F.isnan(number(c)), number(c)) for c in columns if c in df.columns})


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """Calibration fields from CSV, or from JSON {"values": [[header...], [row...], ...]}."""
    if not path.endswith(".json"):
        return coerce_numbers(spark.read.option("header", True).csv(path), CALIBRATION_NUMBERS)
    payload = spark.read.option("multiLine", True).schema("values array<array<string>>").json(path)
    header = payload.select(F.col("values")[0].alias("h")).first()["h"]
    rows = payload.select(F.posexplode("values").alias("i", "r")).filter("i > 0")
    table = rows.select(*[F.col("r")[k].alias(name) for k, name in enumerate(header)])
    return coerce_numbers(table, CALIBRATION_NUMBERS)


def read_bands(spark: SparkSession, path: str) -> DataFrame:
    """Selected wavelengths (rank, band_index, wavelength_nm); a missing column fails."""
    raw = spark.read.option("header", True).csv(path)
    missing = {"rank", "band_index", "wavelength_nm"} - set(raw.columns)
    if missing:
        raise ValueError(f"band list lacks {sorted(missing)}")
    return raw.select(
        F.col("rank").cast("bigint"), F.col("band_index").cast("bigint"), F.col("wavelength_nm").cast("double")
    )


def write_bands(df: DataFrame, path: str) -> None:
    """One ordered CSV file; a band list is bounded by the axis."""
    df.select("rank", "band_index", "wavelength_nm").orderBy("rank").coalesce(1).write.mode("overwrite").option(
        "header", True
    ).csv(path)


def save_linear(model: DataFrame, path: str, variant: str = "spectral_radial_stats") -> None:
    """Store a one-row linear model with its input variant as Parquet."""
    model.withColumn("variant", F.lit(variant)).write.mode("overwrite").parquet(path)


def load_linear(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to this folder was committed; an aborted one leaves no marker."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def cached(df: DataFrame, base: str, config: dict, rebuild: bool = False) -> DataFrame:
    """Read the table stored for this configuration, computing and storing it first when absent.

    The folder name is a hash of the configuration and the schema, so a changed setting never meets old rows.
    """
    spark = df.sparkSession
    text = json.dumps(config, sort_keys=True, default=str) + df.schema.json()
    path = f"{base}/{hashlib.sha1(text.encode()).hexdigest()}"
    if not rebuild and _complete(spark, path):
        return spark.read.schema(df.schema).parquet(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def centers_export(images: DataFrame, centers: DataFrame, key: str, settings: dict) -> DataFrame:
    """(key, count, centers ARRAY<STRUCT>, settings) per image; images without detections have an empty array.

    Centers per image are bounded by the detector's own limit.
    """
    entry = F.struct("y", "x", "box_conf", "kp_conf", "joint")
    packed = centers.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("centers"))
    out = images.select(key).distinct().join(packed, key, "left")
    return out.select(
        key,
        F.greatest(F.lit(0), F.size(F.coalesce("centers", F.array()))).alias("count"),
        F.coalesce("centers", F.array().cast(packed.schema["centers"].dataType)).alias("centers"),
        F.struct(*[F.lit(v).alias(k) for k, v in settings.items()]).alias("settings"),
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per run of batch manifests; another mode or no runs fails the job."""
    raw = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", False).json(path)
    good = (F.col("mode") == "batch") & (F.size("runs") > 0)
    checked = raw.filter(
        F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("not a batch manifest with runs")))
    )
    return checked.select(F.explode("runs").alias("r")).select(
        "r.image", "r.inference_ms", "r.preprocess.*", F.col("r.outputs")[0]["file"].alias("output")
    )


def write_result(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Result table as CSV with header, JSON lines or Parquet (UTF-8, no byte-order mark)."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)
