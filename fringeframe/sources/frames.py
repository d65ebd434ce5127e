"""Frame folders: listing, position parsing, gray pixels, and stacking into cubes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeframe.operators.catalog import first_per_class
from fringeframe.operators.skew import group_rank

IMAGE_SUFFIX = r"(?i)\.(jpg|jpeg|png|bmp|tif|tiff)$"


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def parse_frames(paths: DataFrame) -> DataFrame:
    """Image paths with scan_id (folder) and position; an image not named pos_<signed int> fails the job."""
    digits = F.regexp_extract(stem(F.col("path")), r"^pos_(-?\d+)$", 1)
    bad = F.raise_error(F.concat(F.lit("image names must be pos_<integer>: "), F.col("path")))
    return paths.filter(F.col("path").rlike(IMAGE_SUFFIX)).select(
        "*", folder(F.col("path")).alias("scan_id"), F.when(digits == "", bad).otherwise(digits).cast("bigint").alias("position")
    )


def list_frames(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime, scan_id, position) of landed frames; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return parse_frames(files.select("path", "length", "modificationTime"))


def _gray(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            data = np.frombuffer(row.data, dtype=np.uint8).astype(np.int64)
            if row.channels >= 3:
                b, g, r = (data[c :: row.channels] for c in range(3))
                data = (19595 * r + 38470 * g + 7471 * b + 32768) >> 16
            out.append(data.astype(np.float32))
        yield pd.DataFrame(
            {"path": batch["path"], "height": batch["height"], "width": batch["width"], "pixels": out}
        )


def read_gray(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, pixels ARRAY<FLOAT>) of every image, luma weights 299/587/114, 0..255.

    Files without an image suffix are left out; an image that can't be decoded fails the job.
    """
    images = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path)
    broken = F.raise_error(F.concat(F.lit("not an image: "), F.col("image.origin")))
    images = images.filter(F.col("image.origin").rlike(IMAGE_SUFFIX)).filter(F.when(F.col("image.height") < 1, broken).otherwise(F.lit(True)))
    flat = images.select(
        F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data"
    )
    return flat.mapInPandas(_gray, "path string, height int, width int, pixels array<float>")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Gray frames with scan_id and position."""
    return parse_frames(read_gray(spark, path))


def frames_to_cubes(images: DataFrame, cap_per_category: int | None = None) -> DataFrame:
    """Stack each folder's images into a cube: band by numeric stem, other names last, then by name.

    Paths are .../<category>/<roi>/<image>. Paths differing only in case count once; images of unequal
    shape in a folder fail the job. Output: cube_id, category, band, height, width, pixels.
    """
    name = stem(F.col("path"))
    number = F.when(name.rlike(r"^\d+$"), name.cast("bigint"))
    rows = (
        images.withColumn("_key", F.lower("path"))
        .dropDuplicates(["_key"])
        .select(
            F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1).alias("category"),
            folder(F.col("path")).alias("cube_id"),
            F.coalesce(number, F.lit(2**62)).alias("_number"),
            name.alias("_name"),
            "height",
            "width",
            "pixels",
        )
    )
    if cap_per_category is not None:
        rois = rows.select("category", "cube_id").distinct()
        kept = first_per_class(rois, "category", [F.col("cube_id")], cap_per_category)
        rows = rows.join(kept.select("category", "cube_id"), ["category", "cube_id"], "left_semi")
    shapes = rows.groupBy("category", "cube_id").agg(
        (F.min(F.struct("height", "width")) == F.max(F.struct("height", "width"))).alias("_same")
    )
    ranked = group_rank(rows, ["category", "cube_id"], [F.col("_number"), F.col("_name")], F.col("_number"), "_rank")
    return ranked.join(shapes, ["category", "cube_id"]).select(
        "category",
        "cube_id",
        F.when(F.col("_same"), F.col("_rank") - 1)
        .otherwise(F.raise_error(F.concat(F.lit("images of unequal shape in "), F.col("cube_id"))))
        .alias("band"),
        "height",
        "width",
        "pixels",
    )
