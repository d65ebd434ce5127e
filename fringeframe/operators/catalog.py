"""Catalog discovery, validation guards and train/test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fringeframe.functions.arrays import finite
from fringeframe.functions.draws import HEX32_MAX, hash32
from fringeframe.operators.skew import group_rank

# Fixed values: (class index, sample prefix, train folder, label).
CLASS_DIM = [
    (0, "cmb", "DATACMB", "CMB"),
    (1, "dqb", "DATADQB", "DQB"),
    (2, "dwb", "DATADWB", "DWB"),
    (3, "wq", "DATAWQ", "WQ"),
    (4, "ymxb", "DATAYMXB", "YMXB"),
]


def class_dimension(spark) -> DataFrame:
    """(class_index, prefix, folder, label), five rows."""
    return spark.createDataFrame(CLASS_DIM, "class_index bigint, prefix string, folder string, label string")


def trailing_number(name: Column, missing: int = 10**9) -> Column:
    """Trailing digits of a name as BIGINT; names without them get `missing`."""
    digits = F.regexp_extract(name, r"(\d+)$", 1)
    return F.when(digits == "", F.lit(missing)).otherwise(digits.cast("bigint")).cast("bigint")


def sample_catalog(paths: DataFrame, class_dim: DataFrame) -> DataFrame:
    """Class and subset of header paths `<folder>[_test]/<name>.hdr`; a class folder without files fails.

    `paths` has one `path` column. `natural` orders samples within a folder.
    """
    parsed = (
        paths.withColumn("_dir", F.regexp_extract("path", r"([^/]+)/[^/]+\.hdr$", 1))
        .withColumn("name", F.regexp_extract("path", r"([^/]+)\.hdr$", 1))
        .filter(F.col("name") != "")
        .withColumn("subset", F.when(F.col("_dir").endswith("_test"), "test").otherwise("train"))
        .withColumn("folder", F.regexp_replace("_dir", "_test$", ""))
    )
    expected = class_dim.select(
        "class_index", "label", "folder", F.explode(F.array(F.lit("train"), F.lit("test"))).alias("subset")
    )
    found = expected.join(parsed, ["folder", "subset"], "left")
    return found.withColumn(
        "name",
        F.when(
            F.col("path").isNull(), F.raise_error(F.concat(F.lit("missing class folder: "), "folder", F.lit("/"), "subset"))
        ).otherwise(F.col("name")),
    ).select("class_index", "label", "subset", "name", "path", trailing_number(F.col("name")).alias("natural"))


def first_per_class(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """First k rows of each class; the rank limit is applied before the shuffle."""
    from pyspark.sql import Window

    return (
        df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
        .filter(F.col("rank") <= k)
        .withColumn("rank", F.col("rank").cast("bigint"))
    )


def sanitised(name: Column) -> Column:
    """Replace runs outside [0-9A-Za-z._-] by '_', strip '._-', empty becomes 'sequence' (fixed values of the name format)."""
    clean = F.regexp_replace(F.trim(name), r"[^0-9A-Za-z._-]+", "_")
    clean = F.regexp_replace(clean, r"^[._-]+|[._-]+$", "")
    return F.when(clean == "", F.lit("sequence")).otherwise(clean)


def sequence_catalog(folders: DataFrame, classes: list[str], skip_prefixes: list[str] | None = None) -> DataFrame:
    """Class from the longest class-name prefix that ends, or is followed by a digit, '_', '-' or ' '.

    `folders` has one `folder` column. Output is de-duplicated; class_name NULL when nothing fits.
    """
    upper = F.upper("folder")
    class_name = F.coalesce(
        *[
            F.when(upper.rlike(r"^" + _quote(c.upper()) + r"($|[0-9_\- ])"), F.lit(c))
            for c in sorted(classes, key=lambda c: (-len(c), c))
        ]
    )
    kept = folders.select("folder").distinct()
    for prefix in skip_prefixes or []:
        kept = kept.filter(~upper.startswith(prefix.upper()))
    stem = F.regexp_extract("folder", r"^(.+?)[_-]?(\d+)$", 1)
    number = F.regexp_extract("folder", r"^(.+?)[_-]?(\d+)$", 2)
    return kept.select(
        "folder",
        class_name.alias("class_name"),
        sanitised(F.col("folder")).alias("sequence_id"),
        F.when(stem == "", F.col("folder")).otherwise(stem).alias("stem"),
        F.when(number == "", F.lit(-1)).otherwise(number.cast("bigint")).cast("bigint").alias("number"),
    )


def _quote(text: str) -> str:
    import re

    return re.escape(text)


def modal_template(meta: DataFrame, order: str) -> DataFrame:
    """Most common (bands, lines, samples); ties go to the larger image; `path` is the first by `order`."""
    return (
        meta.groupBy("bands", "lines", "samples")
        .agg(F.count(F.lit(1)).alias("n"), F.min_by("path", order).alias("path"))
        .orderBy(F.desc("n"), F.desc(F.col("lines") * F.col("samples")), "bands", "lines")
        .limit(1)
    )


def conformity(cubes: DataFrame, axis: list[float], rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Add `conforms`: same band count and wavelengths within atol + rtol*|template|."""
    template = F.array(*[F.lit(float(w)) for w in axis])
    off = F.exists(
        F.zip_with("wavelengths", template, lambda a, b: ~(F.abs(a - b) <= atol + rtol * F.abs(b))),
        lambda bad: F.coalesce(bad, F.lit(True)),
    )
    return cubes.withColumn("conforms", (F.size("wavelengths") == len(axis)) & ~off)


def assert_conform(cubes: DataFrame, axis: list[float]) -> DataFrame:
    """Pass cubes through; the job fails on the first that does not conform."""
    checked = conformity(cubes, axis)
    return (
        checked.withColumn(
            "conforms",
            F.when(F.col("conforms"), F.lit(True)).otherwise(
                F.raise_error(F.lit("cube does not match the wavelength template"))
            ),
        )
        .filter("conforms")
        .drop("conforms")
    )


def validate_positions(frames: DataFrame, scan: str = "scan_id") -> DataFrame:
    """Per scan: positions are unique and, for more than two frames, evenly stepped.

    n distinct values between lo and hi that are all lo + i*step with step = (hi-lo)/(n-1)
    must be the whole progression, so no ordered pass is needed.
    """
    ends = frames.groupBy(scan).agg(
        F.count(F.lit(1)).alias("frames"),
        F.countDistinct("position").alias("distinct_positions"),
        F.min("position").alias("lo"),
        F.max("position").alias("hi"),
    )
    ends = ends.withColumn(
        "step",
        F.when(
            (F.col("distinct_positions") > 1)
            & ((F.col("hi") - F.col("lo")) % (F.col("distinct_positions") - 1) == 0),
            ((F.col("hi") - F.col("lo")) / (F.col("distinct_positions") - 1)).cast("bigint"),
        ),
    )
    off_grid = (
        frames.join(ends, scan)
        .groupBy(scan)
        .agg(F.count_if((F.col("position") - F.col("lo")) % F.col("step") != 0).alias("off_grid"))
    )
    unique = F.col("frames") == F.col("distinct_positions")
    even = F.col("step").isNotNull() & (F.col("off_grid") == 0)
    return ends.join(off_grid, scan).select(
        scan,
        "frames",
        "distinct_positions",
        F.when(even, F.col("step")).alias("step"),
        (unique & ((F.col("frames") <= 2) | even)).alias("valid"),
    )


def position_gaps(frames: DataFrame, n: int, init: int, step: int, scan: str = "scan_id") -> DataFrame:
    """(scan, kind missing|extra, position) against positions init + step*(i+1), i < n."""
    observed = frames.select(scan, "position").distinct()
    expected = frames.select(scan).distinct().select(
        scan,
        F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_i"),
    ).select(scan, (F.lit(init) + F.lit(step) * F.col("_i")).cast("bigint").alias("position"))
    missing = expected.join(observed, [scan, "position"], "left_anti").select(scan, F.lit("missing").alias("kind"), "position")
    slot = (F.col("position") - init) / step
    extra = observed.filter(~((slot == F.floor(slot)) & slot.between(1, n))).select(
        scan, F.lit("extra").alias("kind"), "position"
    )
    return missing.unionByName(extra)


def repair_positions(frames: DataFrame, scan: str = "scan_id") -> DataFrame:
    """Relabel one misnamed frame per scan when exactly one grid position is missing and one is extra.

    Adds `repaired_position` and `status` (ok, repaired, error; positions stay as named on error).
    The grid starts at the smallest position and uses the most common step (smallest on a tie), so a
    misnamed first frame is an error.
    """
    distinct = frames.select(scan, "position").distinct()
    ranked = group_rank(distinct, [scan], [F.col("position")], F.col("position"), "_i")
    after = ranked.select(scan, (F.col("_i") - 1).alias("_i"), F.col("position").alias("_next"))
    steps = (
        ranked.join(after, [scan, "_i"])
        .groupBy(scan, (F.col("_next") - F.col("position")).alias("_step"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .groupBy(scan)
        .agg(F.min_by("_step", F.struct(-F.col("_c"), F.col("_step"))).alias("_step"))
    )
    validity = validate_positions(frames, scan).select(scan, "frames", "distinct_positions", "valid")
    lows = distinct.groupBy(scan).agg(F.min("position").alias("_lo"))
    facts = validity.join(lows, scan).join(steps, scan, "left")
    slot = (F.col("position") - F.col("_lo")) / F.col("_step")
    on_grid = F.coalesce((slot == F.floor(slot)) & (slot < F.col("frames")), F.lit(False))
    placed = frames.join(facts, scan).withColumn("_on", on_grid)
    sums = placed.groupBy(scan).agg(
        F.count_if("_on").alias("_kept"), F.sum(F.when(F.col("_on"), F.col("position"))).alias("_kept_sum")
    )
    grid_sum = F.col("frames") * F.col("_lo") + F.col("_step") * (F.col("frames") * (F.col("frames") - 1) / 2).cast("bigint")
    fixable = (
        (F.col("frames") == F.col("distinct_positions"))
        & (F.col("frames") >= 3)
        & (F.col("_kept") == F.col("frames") - 1)
    )
    status = F.when(F.col("valid"), "ok").when(fixable, "repaired").otherwise("error")
    return placed.join(sums, scan).select(
        *frames.columns,
        F.when((status == "repaired") & ~F.col("_on"), grid_sum - F.col("_kept_sum"))
        .otherwise(F.col("position"))
        .alias("repaired_position"),
        status.alias("status"),
    )


def uniform_shapes(images: DataFrame, key: str) -> DataFrame:
    """Per scan or cube: one single (width, height)."""
    return images.groupBy(key).agg(
        ((F.min("width") == F.max("width")) & (F.min("height") == F.max("height"))).alias("uniform"),
        F.count(F.lit(1)).alias("frames"),
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Pass rows through; the job fails when a key occurs twice."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return (
        df.join(counts, keys)
        .withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.lit("duplicate key"))).otherwise(F.lit(True)))
        .filter("_ok")
        .drop("_n", "_ok")
    )


def coverage(long: DataFrame, sample: str = "sample_id", axis: str = "band", value: str = "intensity") -> DataFrame:
    """Per sample: distinct axis points, non-finite values, and whether every axis point is present."""
    per_sample = long.groupBy(sample).agg(
        F.countDistinct(axis).alias("points"), F.count_if(~finite(F.col(value))).alias("nonfinite")
    )
    expected = long.agg(F.countDistinct(axis)).scalar()
    return per_sample.withColumn("complete", (F.col("points") == expected) & (F.col("nonfinite") == 0))


def validated_indices(indices, size: int) -> list[int]:
    """Explicit split list: non-empty, integers (no booleans), unique, within 0..size-1."""
    if not isinstance(indices, list) or not indices:
        raise ValueError("split indices must be a non-empty list")
    if any(isinstance(i, bool) or not isinstance(i, int) for i in indices):
        raise ValueError("split indices must be integers")
    if len(set(indices)) != len(indices):
        raise ValueError("split indices must be unique")
    if min(indices) < 0 or max(indices) >= size:
        raise IndexError("split index out of range")
    return indices


def split_by_index(
    catalog: DataFrame, order: list[Column], range_by: Column, spec: dict, key: str = "train", size: int | None = None
) -> DataFrame:
    """Rows whose zero-based rank in `order` is listed in `spec[key]`."""
    if key not in spec:
        raise KeyError(key)
    wanted = validated_indices(spec[key], catalog.count() if size is None else size)
    listed = catalog.sparkSession.createDataFrame([(i,) for i in wanted], "catalog_index bigint")
    ranked = group_rank(catalog, [], order, range_by, "_rn").withColumn("catalog_index", F.col("_rn") - 1).drop("_rn")
    return ranked.join(listed, "catalog_index", "left_semi")


def split_fraction(key: Column) -> Column:
    """Leading 32 bits of sha1(key) as a number in 0..1."""
    return hash32(key) / F.lit(HEX32_MAX)


def hash_split(df: DataFrame, key: str, val: float, test: float, forced: Column | None = None) -> DataFrame:
    """Add `split`: test below `test`, val below `test+val`, else train; `forced` wins when not NULL."""
    u = split_fraction(F.col(key).cast("string"))
    assigned = F.when(u < test, "test").when(u < test + val, "val").otherwise("train")
    return df.withColumn("split", assigned if forced is None else F.coalesce(forced, assigned))


def rank_split(df: DataFrame, key: str, order: list[Column], train: int = 70, test: int = 30) -> DataFrame:
    """First `train` rows per class, then `test` rows; a class with fewer rows fails the job."""
    kept = first_per_class(df, key, order, train + test)
    sizes = kept.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    split = F.when(F.col("rank") <= train, "train").otherwise("test")
    short = F.raise_error(F.lit(f"class with fewer than {train + test} samples"))
    return kept.join(sizes, key).withColumn("split", F.when(F.col("_n") < train + test, short).otherwise(split)).drop("_n")


def stratified_split(df: DataFrame, key: str, sample: str, fraction: float, seed: int) -> DataFrame:
    """Add `split`: per class, the floor(fraction*n + 0.5) smallest sha1(seed|id) are test."""
    digest = F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col(sample).cast("string")))
    ranked = group_rank(
        df.withColumn("_h", digest),
        [key],
        [F.col("_h"), F.col(sample)],
        F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint"),
        "_r",
    )
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    take = F.floor(F.col("_n") * F.lit(fraction) + 0.5)
    return (
        ranked.join(sizes, key)
        .withColumn("split", F.when(F.col("_r") <= take, "test").otherwise("train"))
        .drop("_h", "_r", "_n")
    )


def cap_per_class(df: DataFrame, key: str, sample: str, k: int, seed: int) -> DataFrame:
    """At most k rows per class, chosen by hash order (deterministic, without replacement)."""
    order = [F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col(sample).cast("string"))), F.col(sample)]
    return first_per_class(df, key, order, k).drop("rank")


def cap_total(df: DataFrame, sample: str, k: int, seed: int) -> DataFrame:
    """At most k rows over all classes, chosen by hash order."""
    digest = F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col(sample).cast("string")))
    return df.orderBy(digest, sample).limit(k)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old rows with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def summarize(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts per (outer, inner), per outer and in all; NULL marks a total."""
    return df.rollup(outer, inner).agg(F.count(F.lit(1)).alias("n"))


def inside(df: DataFrame, width: int, height: int, crop: int) -> DataFrame:
    """Centers at least crop/2 away from every edge (bounds included)."""
    m = crop / 2.0
    return df.filter(F.col("x").between(m, width - m) & F.col("y").between(m, height - m))


def center_plan(
    centers: DataFrame, metadata: DataFrame, key: str, width: int, height: int, crop: int, cap: int, seed: int
) -> DataFrame:
    """Labelled centers with their sequence's class, edge-filtered and capped per class.

    A center whose sequence is not in `metadata` fails the job. Needs `ref_id`; metadata has `class_index`.
    """
    joined = centers.join(metadata, key, "left").withColumn(
        "class_index",
        F.when(F.col("class_index").isNull(), F.raise_error(F.lit("center without sequence metadata"))).otherwise(
            F.col("class_index")
        ),
    )
    return cap_per_class(inside(joined, width, height, crop), "class_index", "ref_id", cap, seed)


def parse_box_lines(lines: DataFrame) -> DataFrame:
    """Split label text into class and normalised box; anything but five columns fails the job."""
    parts = F.split(F.trim("line"), r"\s+")
    number = lambda i: F.col("_p")[i].cast("double")
    return (
        lines.withColumn(
            "_p",
            F.when(F.size(parts) == 5, parts).otherwise(F.raise_error(F.lit("label line must have five columns"))),
        )
        .withColumns({"cx": number(1), "cy": number(2), "bw": number(3), "bh": number(4)})
        .drop("_p")
    )


def boxes_to_pose(boxes: DataFrame) -> DataFrame:
    """Add `accepted` and `pose` (`0 cx cy w h cx cy 2`, eight decimals; NULL when rejected)."""
    cx, cy, w, h = (F.col(c) for c in ("cx", "cy", "bw", "bh"))
    slack = 1e-6
    accepted = (
        cx.between(0, 1)
        & cy.between(0, 1)
        & (w > 0)
        & (w <= 1)
        & (h > 0)
        & (h <= 1)
        & (cx - w / 2 >= -slack)
        & (cy - h / 2 >= -slack)
        & (cx + w / 2 <= 1 + slack)
        & (cy + h / 2 <= 1 + slack)
    )
    even = [F.bround(c, 8) for c in (cx, cy, w, h, cx, cy)]
    text = F.format_string("0 %.8f %.8f %.8f %.8f %.8f %.8f 2", *even)
    return boxes.withColumn("accepted", accepted).withColumn("pose", F.when(accepted, text))


def pose_counts(images: DataFrame, poses: DataFrame, image: str) -> DataFrame:
    """Per split: images, images with a pose, poses, rejected boxes. Images without labels count."""
    per_image = poses.groupBy(image).agg(
        F.count_if("accepted").alias("_a"), F.count_if(~F.col("accepted")).alias("_r")
    )
    return (
        images.join(per_image, image, "left")
        .groupBy("split")
        .agg(
            F.count(F.lit(1)).alias("images"),
            F.count_if(F.col("_a") > 0).alias("nonempty"),
            F.coalesce(F.sum("_a"), F.lit(0)).alias("instances"),
            F.coalesce(F.sum("_r"), F.lit(0)).alias("rejected"),
        )
    )


def review_merge(boxes: DataFrame, approved: DataFrame, image: str) -> DataFrame:
    """Approved images turn candidate boxes (source 1) into class 0; `reviewed` marks them."""
    marks = approved.select(image).distinct().withColumn("_m", F.lit(True))
    return (
        boxes.join(marks, image, "left")
        .withColumn("reviewed", F.coalesce("_m", F.lit(False)))
        .withColumn("class_id", F.when(F.col("reviewed"), F.lit(0)).otherwise(F.col("source")))
        .drop("_m")
    )


def candidate_counts(boxes: DataFrame, image: str) -> DataFrame:
    """Candidates (source 1) and manual boxes per image."""
    return boxes.groupBy(image).agg(
        F.count_if(F.col("source") == 1).alias("candidates"), F.count_if(F.col("source") == 0).alias("manual")
    )


def reviewed_set(before: DataFrame, now: DataFrame, image: str) -> DataFrame:
    """Distinct union of reviewed images."""
    return before.select(image).union(now.select(image)).distinct()


def resolve_source(wanted: DataFrame, present: DataFrame, recorded: str, backup: str) -> DataFrame:
    """Add `resolved`: the recorded path when present, else the backup when present, else fail."""
    known = present.select("path").distinct()
    first = known.select(F.col("path").alias(recorded), F.lit(True).alias("_first"))
    second = known.select(F.col("path").alias(backup), F.lit(True).alias("_second"))
    return (
        wanted.join(first, recorded, "left")
        .join(second, backup, "left")
        .withColumn(
            "resolved",
            F.when(F.col("_first"), F.col(recorded))
            .when(F.col("_second"), F.col(backup))
            .otherwise(F.raise_error(F.concat(F.lit("source not found: "), recorded))),
        )
        .drop("_first", "_second")
    )
