"""Queries over detections and labelled centers."""

from __future__ import annotations

from pyspark.sql import functions as F

from fringeframe.operators import detect as H
from fringeframe.operators.settle import settled
from fringeframe.plans.registry import query, tidy
from fringeframe.plans.views import IMAGE_HEIGHT, IMAGE_WIDTH

THRESHOLD, CROP, SPACING, RADIUS = 0.25, 100, 20.0, 20.0


def r(expr: str, name: str | None = None) -> str:
    return f"round({expr},6)+0.0E0 AS {name or expr}"


JUDGED = """jd AS (SELECT *, least(box_conf,kp_conf) AS joint, CASE WHEN box_conf<0.25E0 OR kp_conf<0.25E0 THEN 'confidence' WHEN x<50 OR y<50 OR x>974 OR y>718 THEN 'edge' ELSE 'accepted' END AS verdict FROM v_detections),
ac AS (SELECT field_id, det_id, round_even(x,0) AS x, round_even(y,0) AS y, joint FROM jd WHERE verdict='accepted')"""
SUPPRESSED = """so AS (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY joint DESC, det_id) AS k FROM ac),
sg(field_id, k, kept) AS (SELECT field_id, 0::BIGINT, []::STRUCT(x DOUBLE, y DOUBLE, id BIGINT)[] FROM so GROUP BY 1 UNION ALL
  SELECT sg.field_id, so.k, CASE WHEN len(list_filter(kept, lambda p: (p.x-so.x)*(p.x-so.x)+(p.y-so.y)*(p.y-so.y)<400))=0 THEN list_append(kept, {'x': so.x, 'y': so.y, 'id': so.det_id}) ELSE kept END FROM sg JOIN so ON so.field_id=sg.field_id AND so.k=sg.k+1),
sk AS (SELECT field_id, unnest(kept) AS p FROM (SELECT field_id, arg_max(kept, k) AS kept FROM sg GROUP BY 1)),
sp AS (SELECT ac.* FROM ac JOIN sk ON ac.field_id=sk.field_id AND ac.det_id=sk.p.id)"""
GREEDY = """gp AS (SELECT a.field_id, ref_id, det_id, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS distance FROM v_references a JOIN v_detections b ON a.field_id=b.field_id WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))<=20),
go AS (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY distance, ref_id, det_id) AS k FROM gp),
gg(field_id, k, refs, dets) AS (SELECT field_id, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM go GROUP BY 1 UNION ALL
  SELECT gg.field_id, go.k, CASE WHEN list_contains(refs,ref_id) OR list_contains(dets,det_id) THEN refs ELSE list_append(refs,ref_id) END, CASE WHEN list_contains(refs,ref_id) OR list_contains(dets,det_id) THEN dets ELSE list_append(dets,det_id) END FROM gg JOIN go ON go.field_id=gg.field_id AND go.k=gg.k+1),
gl AS (SELECT field_id, arg_max(refs,k) AS refs, arg_max(dets,k) AS dets FROM gg GROUP BY 1),
gm AS (SELECT gp.* FROM (SELECT field_id, unnest(refs) AS ref_id, unnest(dets) AS det_id FROM gl) JOIN gp USING(field_id, ref_id, det_id))"""


def judged(v):
    return H.judge_detections(v.detections(), THRESHOLD, CROP, IMAGE_WIDTH, IMAGE_HEIGHT)


def greedy(v):
    return H.match_greedy(v.references(), v.detections(), RADIUS)


@query("h1_filter_detections", f"WITH {JUDGED} SELECT field_id, det_id, x, y, {r('joint')} FROM ac")
def h1(v):
    return tidy(H.accepted(judged(v)).select("field_id", "det_id", "x", "y", "joint"))


@query(
    "h1_rejection_counts",
    f"""WITH {JUDGED} SELECT field_id, count(*) AS raw_predictions, count(*) FILTER (WHERE verdict='confidence') AS confidence_rejected, count(*) FILTER (WHERE verdict='edge') AS edge_rejected,
    count(*) FILTER (WHERE verdict='accepted') AS accepted_detections, 0::BIGINT AS duplicate_rejected FROM jd GROUP BY 1""",
)
def h1_counts(v):
    rows = judged(v)
    return tidy(H.rejection_counts(rows, H.accepted(rows)))


@query("h2_suppress_centers", f"WITH RECURSIVE {JUDGED}, {SUPPRESSED} SELECT field_id, det_id, x, y, {r('joint')} FROM sp")
def h2(v):
    kept = H.suppress_centers(H.accepted(judged(v)).select("field_id", "det_id", "x", "y", "joint"), SPACING)
    return tidy(kept)


BOXES = "bo AS (SELECT field_id, det_id, x*0.625E0 AS bx, y*0.625E0+80.0E0 AS yb, 40.0E0+det_id%30 AS bw, 40.0E0+det_id%20 AS bh, box_conf AS score, kp_conf FROM v_detections WHERE box_conf>=0.05E0)"
NMS = """bk AS (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY score DESC, det_id) AS k FROM bo),
bg(field_id, k, kept) AS (SELECT field_id, 0::BIGINT, []::STRUCT(x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, id BIGINT)[] FROM bk GROUP BY 1 UNION ALL
  SELECT bg.field_id, bk.k, CASE WHEN len(list_filter(kept, lambda p: greatest(0.0E0,least(p.x+p.w/2,bx+bw/2)-greatest(p.x-p.w/2,bx-bw/2))*greatest(0.0E0,least(p.y+p.h/2,yb+bh/2)-greatest(p.y-p.h/2,yb-bh/2))
    > 0.3E0*(p.w*p.h+bw*bh-greatest(0.0E0,least(p.x+p.w/2,bx+bw/2)-greatest(p.x-p.w/2,bx-bw/2))*greatest(0.0E0,least(p.y+p.h/2,yb+bh/2)-greatest(p.y-p.h/2,yb-bh/2)))))=0
    THEN list_append(kept, {'x': bx, 'y': yb, 'w': bw, 'h': bh, 'id': det_id}) ELSE kept END FROM bg JOIN bk ON bk.field_id=bg.field_id AND bk.k=bg.k+1),
bs AS (SELECT field_id, p.id AS det_id, p.x AS bx, p.y AS yb FROM (SELECT field_id, unnest(kept) AS p FROM (SELECT field_id, arg_max(kept,k) AS kept FROM bg GROUP BY 1)))"""


def decoded(v):
    scale, left, top = H.letterbox(IMAGE_WIDTH, IMAGE_HEIGHT, 640)
    bx, by = F.col("x") * scale + left, F.col("y") * scale + float(top)
    return v.detections().select(
        "field_id", "det_id", bx.alias("bx"), by.alias("by"),
        (40.0 + F.col("det_id") % 30).alias("bw"), (40.0 + F.col("det_id") % 20).alias("bh"),
        F.col("box_conf").alias("score"), bx.alias("kx"), by.alias("ky"), "kp_conf",
        F.lit(scale).alias("scale"), F.lit(left).alias("pad_left"), F.lit(top).alias("pad_top"),
    )


@query("h3_nms_boxes", f"WITH RECURSIVE {BOXES}, {NMS} SELECT field_id, det_id, {r('bx')}, {r('yb', chr(34) + 'by' + chr(34))} FROM bs")
def h3(v):
    kept = H.nms_boxes(decoded(v).filter("score >= 0.05"), 0.3)
    return tidy(kept.select("field_id", "det_id", "bx", "by"))


@query(
    "h4_postprocess",
    f"""WITH RECURSIVE {BOXES}, {NMS}, jd AS (SELECT field_id, det_id, least(box_conf,kp_conf) AS joint, bx/0.625E0 AS x, (yb-80.0E0)/0.625E0 AS y,
      CASE WHEN box_conf<0.25E0 OR kp_conf<0.25E0 THEN 'confidence' WHEN bx/0.625E0<50 OR (yb-80.0E0)/0.625E0<50 OR bx/0.625E0>974 OR (yb-80.0E0)/0.625E0>718 THEN 'edge' ELSE 'accepted' END AS verdict
      FROM bs JOIN (SELECT field_id, det_id, box_conf, kp_conf FROM v_detections) USING(field_id, det_id)),
    ac AS (SELECT field_id, det_id, round_even(x,0) AS x, round_even(y,0) AS y, joint FROM jd WHERE verdict='accepted'), {SUPPRESSED},
    al AS (SELECT field_id, count(*) AS n FROM v_detections GROUP BY 1)
    SELECT al.field_id, coalesce(raw,0) AS raw_predictions, coalesce(cr,0)+n-coalesce(raw,0) AS confidence_rejected, coalesce(er,0) AS edge_rejected, coalesce(ok,0)-coalesce(kept,0) AS duplicate_rejected, coalesce(kept,0) AS accepted_detections
    FROM al LEFT JOIN (SELECT field_id, count(*) AS raw, count(*) FILTER (WHERE verdict='confidence') AS cr, count(*) FILTER (WHERE verdict='edge') AS er, count(*) FILTER (WHERE verdict='accepted') AS ok FROM jd GROUP BY 1) USING(field_id)
    LEFT JOIN (SELECT field_id, count(*) AS kept FROM sp GROUP BY 1) USING(field_id)""",
)
def h4(v):
    _kept, counts = H.postprocess(decoded(v), THRESHOLD, 0.3, None, CROP, SPACING, IMAGE_WIDTH, IMAGE_HEIGHT)
    return tidy(counts)


@query("h5_match_greedy", f"WITH RECURSIVE {GREEDY} SELECT field_id, ref_id, det_id, {r('distance')} FROM gm")
def h5(v):
    return tidy(greedy(v))


@query("h6_match_hungarian")
def h6(v):
    return tidy(H.match_hungarian(v.references(), v.detections()))


@query("h7_match_penalised")
def h7(v):
    return tidy(H.match_penalised(v.references(), v.detections(), RADIUS))


NEAREST = "nr AS (SELECT a.field_id, ref_id, min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) AS d FROM v_references a JOIN v_detections b ON a.field_id=b.field_id AND b.det_id%3<>0 GROUP BY 1,2)"


@query(
    "h8_center_agreement",
    f"WITH {NEAREST} SELECT field_id, count(*) AS \"references\", count(*) FILTER (WHERE d<=2) AS within_2px, count(*) FILTER (WHERE d<=5) AS within_5px, {r('avg(d)', 'mean_distance')}, {r('max(d)', 'max_distance')} FROM nr GROUP BY 1",
)
def h8(v):
    return tidy(H.center_agreement(v.references(), v.detections().filter("det_id % 3 <> 0")))


FIELDS = """fm AS (SELECT field_id, coalesce(g,0) AS ground_truth_count, coalesce(p,0) AS predicted_count, coalesce(t5,0) AS tp_5px, coalesce(t10,0) AS tp_10px, coalesce(t20,0) AS tp_20px
  FROM (SELECT field_id, count(*) AS g FROM v_references GROUP BY 1) FULL JOIN (SELECT field_id, count(*) AS p FROM v_detections GROUP BY 1) USING(field_id)
  LEFT JOIN (SELECT field_id, count(*) FILTER (WHERE distance<=5) AS t5, count(*) FILTER (WHERE distance<=10) AS t10, count(*) FILTER (WHERE distance<=20) AS t20 FROM gm GROUP BY 1) USING(field_id))"""


def prf(tp: str, p: str, g: str, s: str) -> str:
    a, b = f"(CASE WHEN {p}=0 THEN 0.0E0 ELSE {tp}/{p}::DOUBLE END)", f"(CASE WHEN {g}=0 THEN 0.0E0 ELSE {tp}/{g}::DOUBLE END)"
    return f"{r(a, f'precision_{s}')}, {r(b, f'recall_{s}')}, {r(f'CASE WHEN {a}+{b}=0 THEN 0.0E0 ELSE 2.0E0*{a}*{b}/({a}+{b}) END', f'f1_{s}')}"


@query(
    "h9_field_metrics",
    f"""WITH RECURSIVE {GREEDY}, {FIELDS} SELECT *, predicted_count-ground_truth_count AS count_error, abs(predicted_count-ground_truth_count) AS absolute_count_error,
    {', '.join(prf(f'tp_{k}px', 'predicted_count', 'ground_truth_count', f'{k}px') for k in (5, 10, 20))} FROM fm""",
)
def h9(v):
    return tidy(H.field_metrics(greedy(v), v.references(), v.detections()))


@query(
    "h10_pooled_metrics",
    f"""WITH RECURSIVE {GREEDY}, {FIELDS}, s AS (SELECT count(*) AS images, CAST(sum(ground_truth_count) AS BIGINT) AS ground_truth_centers, CAST(sum(predicted_count) AS BIGINT) AS predicted_centers, avg(abs(predicted_count-ground_truth_count)) AS mae,
      sqrt(avg((predicted_count-ground_truth_count)**2)) AS rmse, CAST(sum(tp_5px) AS BIGINT) AS tp_5px, CAST(sum(tp_10px) AS BIGINT) AS tp_10px, CAST(sum(tp_20px) AS BIGINT) AS tp_20px FROM fm)
    SELECT images, ground_truth_centers, predicted_centers, {r('mae', 'count_mae')}, {r('rmse', 'count_rmse')}, tp_5px, tp_10px, tp_20px, round((SELECT avg(distance) FROM gm),6)+0.0E0 AS center_error_mean, round((SELECT max(distance) FROM gm),6)+0.0E0 AS center_error_max,
      round((SELECT quantile_cont(distance,0.5E0) FROM gm),6)+0.0E0 AS center_error_median, round((SELECT quantile_cont(distance,0.95E0) FROM gm),6)+0.0E0 AS center_error_p95,
      {', '.join(prf(f'tp_{k}px', 'predicted_centers', 'ground_truth_centers', f'{k}px') for k in (5, 10, 20))} FROM s""",
)
def h10(v):
    matches = settled(greedy(v))
    return tidy(H.pooled_metrics(H.field_metrics(matches, v.references(), v.detections()), matches))


@query("h11_threshold_sweep")
def h11(v):
    thresholds = [i / 10 for i in range(1, 9)]
    return tidy(
        H.threshold_sweep(v.detections(), v.references(), thresholds, CROP, SPACING, IMAGE_WIDTH, IMAGE_HEIGHT)
    )


@query(
    "h12_match_audit",
    f"""WITH RECURSIVE {GREEDY} SELECT field_id, 'unmatched_reference' AS kind, ref_id AS id FROM v_references WHERE ref_id NOT IN (SELECT ref_id FROM gm WHERE gm.field_id=v_references.field_id)
    UNION ALL SELECT field_id, 'unmatched_detection', det_id FROM v_detections WHERE det_id NOT IN (SELECT det_id FROM gm WHERE gm.field_id=v_detections.field_id)""",
)
def h12(v):
    return tidy(H.match_audit(greedy(v), v.references(), v.detections()))


@query(
    "h12_matched_class_accuracy",
    f"""WITH RECURSIVE {GREEDY}, f AS (SELECT DISTINCT field_id FROM v_detections), m AS (SELECT field_id, count(*) AS matched, count(*) FILTER (WHERE det_id%5=field_id%5) AS correct FROM gm GROUP BY 1)
    SELECT field_id, coalesce(matched,0) AS matched, coalesce(correct,0) AS correct, round(correct/matched::DOUBLE,6)+0.0E0 AS accuracy FROM f LEFT JOIN m USING(field_id)""",
)
def h12_accuracy(v):
    labels = v.detections().select("field_id", "det_id", (F.col("det_id") % 5).alias("label"))
    expected = v.detections().select("field_id").distinct().withColumn("label", F.col("field_id") % 5)
    return tidy(H.matched_class_accuracy(greedy(v), labels, expected))


@query(
    "h13_latency_stats",
    f"""SELECT scan_id, count(*) AS n, {r('avg(capture_seconds*1000)', 'mean_ms')}, {r('stddev_samp(capture_seconds*1000)', 'sd_ms')}, {r('min(capture_seconds*1000)', 'min_ms')}, {r('max(capture_seconds*1000)', 'max_ms')}, {r('1000.0E0/avg(capture_seconds*1000)', 'fps')} FROM v_frames WHERE captured GROUP BY 1""",
)
def h13(v):
    return tidy(H.latency_stats(v.frames().filter("captured"), "capture_seconds", ["scan_id"]))


@query(
    "h14_numeric_agreement",
    f"""WITH j AS (SELECT intensity AS a, intensity*1.01E0+0.001E0*(sample_id%7) AS b FROM v_spectra) SELECT count(*) AS n, {r('corr(a,b)', 'correlation')}, {r('avg(abs(a-b))', 'mae')}, {r('sqrt(avg((a-b)**2))', 'rmse')}, {r('max(abs(a-b))', 'max_abs')} FROM j""",
)
def h14(v):
    a = v.spectra().select("sample_id", F.posexplode("spectrum").alias("band", "intensity"))
    b = a.withColumn("intensity", F.col("intensity") * 1.01 + 0.001 * (F.col("sample_id") % 7))
    return tidy(H.numeric_agreement(a, b, ["sample_id", "band"], "intensity"))


@query(
    "h15_detection_report",
    f"""WITH {JUDGED} SELECT field_id, det_id, x, y, row_number() OVER (PARTITION BY field_id ORDER BY y, x, det_id) AS roi_id, CASE WHEN det_id%4<>0 THEN det_id%5 END AS predicted_index, CASE WHEN det_id%4<>0 THEN round(joint*2.0E0,6)+0.0E0 END AS margin FROM ac""",
)
def h15(v):
    dets = H.accepted(judged(v))
    scores = dets.filter("det_id % 4 <> 0").select(
        "field_id", "det_id", (F.col("det_id") % 5).alias("predicted_index"), (F.col("joint") * 2.0).alias("margin")
    )
    report = H.detection_report(dets.select("field_id", "det_id", "x", "y"), scores)
    return tidy(report)


@query(
    "h16_local_maxima",
    """WITH a AS (SELECT *, max(intensity) OVER (PARTITION BY cube_id, band, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m1, quantile_cont(intensity,0.7E0) OVER (PARTITION BY cube_id, band) AS t FROM v_pixels),
    b AS (SELECT *, max(m1) OVER (PARTITION BY cube_id, band, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM a)
    SELECT cube_id, band, y*8+x AS det_id, x::DOUBLE AS x, y::DOUBLE AS y, round(intensity*(0.25E0+least((cube_id%5)*1.0E0,3.0E0)),6)+0.0E0 AS joint FROM b
    WHERE intensity>=t AND intensity>=m-1.0E-6 AND x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 AND (cube_id%5)*1.0E0>=1.0E0""",
)
def h16(v):
    support = (F.col("cube_id") % 5).cast("double")
    return tidy(H.local_maxima(v.images(), 3, 70.0, 1, support, 1.0, ["cube_id", "band"]))


@query(
    "h17_nearest_center",
    """WITH p AS (SELECT field_id, ref_id, x+3.0E0 AS x, y-2.0E0 AS y FROM v_references), d AS (SELECT p.field_id, ref_id, det_id, sqrt((p.x-b.x)*(p.x-b.x)+(p.y-b.y)*(p.y-b.y)) AS distance FROM p JOIN v_detections b ON p.field_id=b.field_id)
    SELECT field_id, ref_id, det_id, round(distance,6)+0.0E0 AS distance FROM (SELECT *, row_number() OVER (PARTITION BY field_id, ref_id ORDER BY distance, det_id) AS k FROM d WHERE distance<=12) WHERE k=1""",
)
def h17(v):
    clicks = v.references().withColumn("x", F.col("x") + 3.0).withColumn("y", F.col("y") - 2.0)
    return tidy(H.nearest_centers(clicks, v.detections(), [12.0]))
