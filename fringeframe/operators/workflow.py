"""The whole measurement as one plan: frames and raw detections to particle counts and concentrations per field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeframe.operators.calibrate import class_counts, concentration
from fringeframe.operators.detect import accepted, judge_detections, suppress_centers
from fringeframe.operators.ml import score_linear
from fringeframe.operators.spatial import crop_rois, features


def measure_fields(
    frames: DataFrame,
    detections: DataFrame,
    model: DataFrame,
    labels: list[str],
    bands: list[int],
    bins: int,
    slope: float,
    intercept: float,
    threshold: float = 0.25,
    crop: int = 100,
    spacing: float = 20.0,
    size: tuple[int, int] = (1024, 768),
    variant: str = "spectral_radial_stats",
    tile: int = 256,
) -> DataFrame:
    """(field_id, label, count, total_count, concentration, total_concentration) for every field with frames and every label.

    `frames` (field_id, band, height, width, pixels), `detections` (field_id, det_id, x, y, box_conf, kp_conf), `model` as in
    `score_linear`, whose classes are places in `labels`. Detections are filtered, thinned, cropped from every frame, turned into
    features and classified; the counts go through the calibration line. Fields without an accepted detection count 0.
    """
    width, height = size
    centers = suppress_centers(accepted(judge_detections(detections, threshold, crop, width, height)), spacing)
    rois = crop_rois(frames.select("field_id", "band", "height", "width", "pixels"), centers, "field_id", crop, True, tile)
    # A detection is a cube of its own from here on.
    cubes = rois.select(F.struct("field_id", "det_id").alias("cube_id"), F.lit(None).cast("bigint").alias("class_index"), "band", "height", "width", "pixels")
    scored = score_linear(features(cubes, bands, bins, variant), model, variant)
    names = F.array(*[F.lit(name) for name in labels])
    objects = scored.select("cube_id.field_id", F.element_at(names, (F.col("predicted_index") + 1).cast("int")).alias("label"))
    return concentration(class_counts(objects, frames, labels), slope, intercept)
