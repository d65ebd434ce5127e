"""Queries over catalogs, scans and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from fringeframe.operators import catalog as C
from fringeframe.plans.registry import query, tidy
from fringeframe.plans.views import BANDS, IMAGE_HEIGHT, IMAGE_WIDTH, WAVELENGTH_START


@query(
    "a4_sample_catalog",
    """SELECT CAST(label%5 AS BIGINT) AS class_index, CASE label%5 WHEN 0 THEN 'CMB' WHEN 1 THEN 'DQB' WHEN 2 THEN 'DWB' WHEN 3 THEN 'WQ' ELSE 'YMXB' END AS label,
      CASE WHEN vec_id%10<3 THEN 'test' ELSE 'train' END AS subset, 's_'||CAST(vec_id AS VARCHAR) AS name, CAST(vec_id AS BIGINT) AS natural_order FROM embeddings""",
)
def a4(v):
    dim = C.class_dimension(v.spark)
    folder = F.concat("folder", F.when(F.col("sample_id") % 10 < 3, "_test").otherwise(""))
    paths = v.spectra().join(dim, "class_index").select(
        F.format_string("/data/%s/s_%d.hdr", folder, F.col("sample_id")).alias("path")
    )
    return tidy(C.sample_catalog(paths, dim).select("class_index", "label", "subset", "name", F.col("natural").alias("natural_order")))


@query(
    "a5_augmented_catalog",
    """SELECT class_index, sample_id, rank FROM (SELECT class_index, sample_id,
      CAST(row_number() OVER (PARTITION BY class_index ORDER BY sample_id) AS BIGINT) AS rank FROM v_spectra WHERE band=0) WHERE rank<=20""",
)
def a5(v):
    named = v.spectra().withColumn("name", F.format_string("synthetic_%04d", F.col("sample_id")))
    order = [C.trailing_number(F.col("name")), F.col("name")]
    return tidy(C.first_per_class(named, "class_index", order, 20).select("class_index", "sample_id", "rank"))


@query(
    "a6_sequence_catalog",
    """SELECT DISTINCT sequence_id AS folder, CASE WHEN regexp_matches(upper(sequence_id),'^SRC1($|[0-9_\\- ])') THEN CASE WHEN regexp_matches(upper(sequence_id),'^SRC1[0-9]') THEN
        CASE WHEN regexp_matches(upper(sequence_id),'^SRC12($|[0-9_\\- ])') THEN 'src12' ELSE 'src1' END ELSE 'src1' END
      WHEN regexp_matches(upper(sequence_id),'^SRC0($|[0-9_\\- ])') THEN 'src0' END AS class_name,
      sequence_id, regexp_extract(sequence_id,'^(.+?)[_-]?([0-9]+)$',1) AS stem, CAST(regexp_extract(sequence_id,'^(.+?)[_-]?([0-9]+)$',2) AS BIGINT) AS number
    FROM v_names WHERE NOT starts_with(upper(sequence_id),'SRC4')""",
)
def a6(v):
    folders = v.names().select(F.col("sequence_id").alias("folder"))
    return tidy(C.sequence_catalog(folders, ["src0", "src1", "src12"], ["src4"]))


META = "SELECT cube_id, count(DISTINCT band) AS bands, max(y)+1 AS lines, max(x)+1 AS samples FROM v_pixels GROUP BY cube_id"


@query(
    "b1_modal_template",
    f"""WITH meta AS ({META}) SELECT bands, lines, samples, count(*) AS n, min('cube_'||CAST(lpad(CAST(cube_id AS VARCHAR),8,'0') AS VARCHAR)) AS path
    FROM meta GROUP BY bands, lines, samples ORDER BY n DESC, lines*samples DESC LIMIT 1""",
)
def b1(v):
    meta = v.images().groupBy("cube_id").agg(
        F.countDistinct("band").alias("bands"), F.max("height").alias("lines"), F.max("width").alias("samples")
    ).withColumn("path", F.concat(F.lit("cube_"), F.lpad(F.col("cube_id").cast("string"), 8, "0")))
    return tidy(C.modal_template(meta, "cube_id"))


@query(
    "b2_conformity",
    """SELECT sample_id, bool_and(abs(w-wavelength_nm) <= 1.0E-8+1.0E-5*abs(wavelength_nm)) AS conforms
    FROM (SELECT *, wavelength_nm + CASE WHEN sample_id%7=0 THEN 0.01E0*band ELSE 0.0E0 END AS w FROM v_spectra) GROUP BY sample_id""",
)
def b2(v):
    axis = [WAVELENGTH_START + i for i in range(BANDS)]
    drift = F.when(F.col("sample_id") % 7 == 0, F.lit(0.01)).otherwise(F.lit(0.0))
    cubes = v.spectra().select(
        "sample_id", F.transform("spectrum", lambda _v, i: WAVELENGTH_START + i + drift * i).alias("wavelengths")
    )
    return C.conformity(cubes, axis).select("sample_id", "conforms")


@query(
    "b3_validate_positions",
    """WITH f AS (SELECT scan_id, position + CASE WHEN scan_id%5=0 AND captured=false THEN 3 ELSE 0 END AS position FROM v_frames WHERE scan_id%2=0 OR captured),
    d AS (SELECT *, lead(position) OVER (PARTITION BY scan_id ORDER BY position)-position AS step FROM f)
    SELECT scan_id, count(*) AS frames, count(DISTINCT position) AS distinct_positions,
      CASE WHEN count(DISTINCT step)=1 AND count(*)=count(DISTINCT position) THEN max(step) END AS step,
      count(*)=count(DISTINCT position) AND (count(*)<=2 OR count(DISTINCT step)=1) AS valid FROM d GROUP BY scan_id""",
)
def b3(v):
    frames = v.frames().filter((F.col("scan_id") % 2 == 0) | F.col("captured"))
    moved = F.when((F.col("scan_id") % 5 == 0) & ~F.col("captured"), 3).otherwise(0)
    return tidy(C.validate_positions(frames.withColumn("position", F.col("position") + moved)))


@query(
    "b4_position_gaps",
    """WITH o AS (SELECT DISTINCT scan_id, position FROM v_frames WHERE captured),
    e AS (SELECT scan_id, -900000+4000*i AS position FROM (SELECT DISTINCT scan_id FROM o), range(1,61) r(i))
    SELECT scan_id, 'missing' AS kind, position FROM (SELECT * FROM e EXCEPT SELECT * FROM o)
    UNION ALL SELECT scan_id, 'extra', position FROM (SELECT * FROM o EXCEPT SELECT * FROM e)""",
)
def b4(v):
    return tidy(C.position_gaps(v.frames().filter("captured"), 60, -900000, 4000))


@query(
    "b5_repair_positions",
    """WITH f AS (SELECT scan_id, event_id, position + CASE WHEN scan_id%3=0 AND position=-900000+4000*5 THEN 1500 WHEN scan_id%7=0 AND position<=-900000+4000*2 THEN 1 ELSE 0 END AS position FROM v_frames),
    d AS (SELECT *, lead(position) OVER (PARTITION BY scan_id ORDER BY position)-position AS step FROM f),
    c AS (SELECT scan_id, step, count(*) AS c FROM d WHERE step>0 GROUP BY scan_id, step),
    m AS (SELECT scan_id, step FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY c DESC, step) AS r FROM c) WHERE r=1),
    s AS (SELECT scan_id, count(*) AS n, count(DISTINCT position) AS nd, count(DISTINCT step) AS ns, min(position) AS lo FROM d GROUP BY scan_id),
    p AS (SELECT f.*, s.n, s.lo, m.step, s.n=s.nd AND (s.n<=2 OR s.ns=1) AS valid,
        coalesce((f.position-s.lo)%m.step=0 AND (f.position-s.lo)//m.step<s.n,false) AS on_grid FROM f JOIN s USING(scan_id) LEFT JOIN m USING(scan_id)),
    k AS (SELECT scan_id, count(*) FILTER (WHERE on_grid) AS kept, CAST(sum(position) FILTER (WHERE on_grid) AS BIGINT) AS kept_sum FROM p GROUP BY scan_id)
    SELECT scan_id, event_id, position,
      CAST(CASE WHEN NOT valid AND n>=3 AND kept=n-1 AND NOT on_grid THEN n*lo+step*(n*(n-1)//2)-kept_sum ELSE position END AS BIGINT) AS repaired_position,
      CASE WHEN valid THEN 'ok' WHEN n>=3 AND kept=n-1 THEN 'repaired' ELSE 'error' END AS status FROM p JOIN k USING(scan_id)""",
)
def b5(v):
    p = F.col("position")
    shift = (
        F.when((F.col("scan_id") % 3 == 0) & (p == -880000), 1500)
        .when((F.col("scan_id") % 7 == 0) & (p <= -892000), 1)
        .otherwise(0)
    )
    frames = v.frames().select("scan_id", "event_id", (p + shift).alias("position"))
    return tidy(C.repair_positions(frames))


@query(
    "b6_uniform_shapes",
    """SELECT cube_id, count(DISTINCT w)=1 AS uniform, count(*) AS frames FROM (SELECT DISTINCT cube_id, band, CASE WHEN cube_id%4=0 AND band=3 THEN 9 ELSE 8 END AS w FROM v_pixels) GROUP BY cube_id""",
)
def b6(v):
    wide = F.when((F.col("cube_id") % 4 == 0) & (F.col("band") == 3), F.col("width") + 1).otherwise(F.col("width"))
    return tidy(C.uniform_shapes(v.images().withColumn("width", wide), "cube_id"))


@query(
    "b7_duplicate_keys",
    """SELECT gradient_id, preparation_id, field_id%3 AS field_slot, count(*) AS n FROM v_calibration GROUP BY ALL HAVING count(*)>1""",
)
def b7(v):
    keyed = v.calibration().withColumn("field_slot", F.col("field_id") % 3)
    return tidy(C.duplicate_keys(keyed, ["gradient_id", "preparation_id", "field_slot"]))


@query(
    "b8_coverage",
    """WITH s AS (SELECT sample_id, band, CASE WHEN sample_id%11=0 AND band=5 THEN NULL ELSE intensity END AS intensity FROM v_spectra WHERE NOT (sample_id%13=0 AND band=7))
    SELECT sample_id, count(DISTINCT band) AS points, count(*) FILTER (WHERE intensity IS NULL) AS nonfinite,
      count(DISTINCT band)=(SELECT count(DISTINCT band) FROM s) AND count(*) FILTER (WHERE intensity IS NULL)=0 AS complete FROM s GROUP BY sample_id""",
)
def b8(v):
    long = v.spectra().select("sample_id", F.posexplode("spectrum").alias("band", "intensity"))
    gap = (F.col("sample_id") % 13 == 0) & (F.col("band") == 7)
    hole = (F.col("sample_id") % 11 == 0) & (F.col("band") == 5)
    long = long.filter(~gap).withColumn("intensity", F.when(~hole, F.col("intensity")))
    return tidy(C.coverage(long))


@query(
    "b9_split_by_index",
    """SELECT catalog_index, sample_id FROM (SELECT sample_id, CAST(row_number() OVER (ORDER BY sample_id) AS BIGINT)-1 AS catalog_index FROM v_predictions)
    WHERE catalog_index IN (SELECT i FROM range(0,1400,7) r(i))""",
)
def b9(v):
    spec = {"train": list(range(0, 1400, 7))}
    key = F.col("sample_id")
    return tidy(C.split_by_index(v.predictions(), [key], key, spec).select("catalog_index", "sample_id"))


@query(
    "b10_hash_split",
    """SELECT sample_id, CASE WHEN sample_id%100=0 THEN 'train' WHEN u<0.15E0 THEN 'test' WHEN u<0.15E0+0.1E0 THEN 'val' ELSE 'train' END AS split
    FROM (SELECT sample_id, CAST(CAST('0x'||substr(sha1(CAST(sample_id AS VARCHAR)),1,8) AS BIGINT) AS DOUBLE)/4294967295.0E0 AS u FROM v_predictions)""",
)
def b10(v):
    forced = F.when(F.col("sample_id") % 100 == 0, "train")
    return tidy(C.hash_split(v.predictions(), "sample_id", 0.1, 0.15, forced).select("sample_id", "split"))


@query(
    "b11_rank_split",
    """SELECT class_index, sample_id, rank, CASE WHEN rank<=60 THEN 'train' ELSE 'test' END AS split FROM (SELECT class_index, sample_id,
      CAST(row_number() OVER (PARTITION BY class_index ORDER BY sample_id) AS BIGINT) AS rank FROM v_spectra WHERE band=0) WHERE rank<=80""",
)
def b11(v):
    out = C.rank_split(v.spectra(), "class_index", [F.col("sample_id")], 60, 20)
    return tidy(out.select("class_index", "sample_id", "rank", "split"))


HASHED = "sha1('7|'||CAST(sample_id AS VARCHAR))"


@query(
    "b12_stratified_split",
    f"""SELECT sample_id, true_index, CASE WHEN r<=floor(n*0.15E0+0.5E0) THEN 'test' ELSE 'train' END AS split FROM (SELECT sample_id, true_index,
      row_number() OVER (PARTITION BY true_index ORDER BY {HASHED}, sample_id) AS r, count(*) OVER (PARTITION BY true_index) AS n FROM v_predictions)""",
)
def b12(v):
    out = C.stratified_split(v.predictions(), "true_index", "sample_id", 0.15, 7)
    return tidy(out.select("sample_id", "true_index", "split"))


@query(
    "b12_cap_per_class",
    f"""SELECT sample_id, true_index FROM (SELECT sample_id, true_index, row_number() OVER (PARTITION BY true_index ORDER BY {HASHED}, sample_id) AS r FROM v_predictions) WHERE r<=100""",
)
def b12_cap(v):
    return tidy(C.cap_per_class(v.predictions(), "true_index", "sample_id", 100, 7).select("sample_id", "true_index"))


@query("b12_cap_total", f"SELECT sample_id, true_index FROM v_predictions ORDER BY {HASHED}, sample_id LIMIT 250")
def b12_total(v):
    return tidy(C.cap_total(v.predictions(), "sample_id", 250, 7).select("sample_id", "true_index"))


@query(
    "b13_upsert",
    """WITH old AS (SELECT sequence_id, class_name, n_chars FROM v_names WHERE ord%3<>0),
    new AS (SELECT sequence_id, 'updated' AS class_name, n_chars+1 AS n_chars FROM v_names WHERE ord%2=0)
    SELECT * FROM old WHERE sequence_id NOT IN (SELECT sequence_id FROM new) UNION ALL SELECT * FROM new""",
)
def b13(v):
    names = v.names()
    old = names.filter("ord % 3 <> 0").select("sequence_id", "class_name", "n_chars")
    new = names.filter("ord % 2 = 0").select(
        "sequence_id", F.lit("updated").alias("class_name"), (F.col("n_chars") + 1).alias("n_chars")
    )
    return tidy(C.upsert(old, new, "sequence_id"))


SPLIT_SQL = """SELECT *, CASE WHEN u<0.15E0 THEN 'test' WHEN u<0.25E0 THEN 'val' ELSE 'train' END AS split
FROM (SELECT *, CAST(CAST('0x'||substr(sha1(CAST(sample_id AS VARCHAR)),1,8) AS BIGINT) AS DOUBLE)/4294967295.0E0 AS u FROM v_predictions)"""


@query("b14_summarize", f"SELECT true_index, split, count(*) AS n FROM ({SPLIT_SQL}) GROUP BY ROLLUP(true_index, split)")
def b14(v):
    return tidy(C.summarize(C.hash_split(v.predictions(), "sample_id", 0.1, 0.15), "true_index", "split"))


@query(
    "b15_inside",
    "SELECT field_id, ref_id, round(x,6)+0.0E0 AS x, round(y,6)+0.0E0 AS y FROM v_references WHERE x BETWEEN 50 AND 974 AND y BETWEEN 50 AND 718",
)
def b15(v):
    return tidy(C.inside(v.references(), IMAGE_WIDTH, IMAGE_HEIGHT, 100))


@query(
    "b16_center_plan",
    """WITH meta AS (SELECT DISTINCT field_id, field_id%5 AS class_index FROM v_detections),
    p AS (SELECT r.*, m.class_index FROM v_references r JOIN meta m USING(field_id) WHERE x BETWEEN 50 AND 974 AND y BETWEEN 50 AND 718)
    SELECT class_index, field_id, ref_id FROM (SELECT *, row_number() OVER (PARTITION BY class_index ORDER BY sha1('11|'||CAST(ref_id AS VARCHAR)), ref_id) AS r FROM p) WHERE r<=200""",
)
def b16(v):
    meta = v.detections().select("field_id").distinct().withColumn("class_index", F.col("field_id") % 5)
    plan = C.center_plan(v.references(), meta, "field_id", IMAGE_WIDTH, IMAGE_HEIGHT, 100, 200, 11)
    return tidy(plan.select("class_index", "field_id", "ref_id"))


@query(
    "b17_boxes_to_pose",
    """WITH b AS (SELECT field_id, CASE WHEN field_id%4=0 THEN 'val' ELSE 'train' END AS split, round(x/1024.0E0,8) AS cx, round(y/768.0E0,8) AS cy,
      round(100.0E0/1024.0E0,8) AS w, round(100.0E0/768.0E0,8) AS h FROM v_detections),
    t AS (SELECT *, cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1 AND cx-w/2>=-1.0E-6 AND cy-h/2>=-1.0E-6 AND cx+w/2<=1+1.0E-6 AND cy+h/2<=1+1.0E-6 AS ok FROM b)
    SELECT split, count(DISTINCT field_id) AS images, count(DISTINCT field_id) FILTER (WHERE ok) AS nonempty, count(*) FILTER (WHERE ok) AS instances,
      count(*) FILTER (WHERE NOT ok) AS rejected FROM t GROUP BY split""",
)
def b17(v):
    det = v.detections()
    lines = det.select(
        "field_id",
        F.format_string(
            "0 %.8f %.8f %.8f %.8f",
            F.col("x") / float(IMAGE_WIDTH),
            F.col("y") / float(IMAGE_HEIGHT),
            F.lit(100.0 / IMAGE_WIDTH),
            F.lit(100.0 / IMAGE_HEIGHT),
        ).alias("line"),
    )
    images = det.select("field_id").distinct().withColumn(
        "split", F.when(F.col("field_id") % 4 == 0, "val").otherwise("train")
    )
    return tidy(C.pose_counts(images, C.boxes_to_pose(C.parse_box_lines(lines)), "field_id"))


@query(
    "b18_review_merge",
    """SELECT field_id, det_id, CASE WHEN field_id%3=0 THEN 0 ELSE det_id%20//10 END AS class_id, field_id%3=0 AS reviewed FROM v_detections""",
)
def b18(v):
    boxes = v.detections().withColumn("source", F.floor(F.col("det_id") % 20 / 10))
    approved = boxes.filter("field_id % 3 = 0")
    return tidy(C.review_merge(boxes, approved, "field_id").select("field_id", "det_id", "class_id", "reviewed"))


@query(
    "b18_candidate_counts",
    """SELECT field_id, count(*) FILTER (WHERE det_id%20//10=1) AS candidates, count(*) FILTER (WHERE det_id%20//10=0) AS manual FROM v_detections GROUP BY field_id""",
)
def b18_counts(v):
    boxes = v.detections().withColumn("source", F.floor(F.col("det_id") % 20 / 10))
    return tidy(C.candidate_counts(boxes, "field_id"))


@query(
    "b18_reviewed_set",
    "SELECT field_id FROM v_detections WHERE det_id%3=0 UNION SELECT field_id FROM v_references WHERE ref_id%7=0",
)
def b18_set(v):
    before = v.detections().filter("det_id % 3 = 0")
    return tidy(C.reviewed_set(before, v.references().filter("ref_id % 7 = 0"), "field_id"))


@query(
    "b19_resolve_source",
    """SELECT sequence_id, CASE WHEN ord%4<>0 THEN '/recorded/' ELSE '/backup/' END || sequence_id AS resolved FROM v_names""",
)
def b19(v):
    wanted = v.names().select(
        "sequence_id",
        "ord",
        F.concat(F.lit("/recorded/"), "sequence_id").alias("recorded"),
        F.concat(F.lit("/backup/"), "sequence_id").alias("backup"),
    )
    present = wanted.filter("ord % 4 <> 0").select(F.col("recorded").alias("path")).union(wanted.select("backup"))
    return C.resolve_source(wanted, present, "recorded", "backup").select("sequence_id", "resolved")


