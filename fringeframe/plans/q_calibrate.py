"""Queries over calibration fields and counted detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from fringeframe.operators import calibrate as G
from fringeframe.plans.registry import query, tidy

X, Y = "mean_ring", "mean_reference"
LABELS = ["CMB", "DQB", "DWB", "WQ", "YMXB", "NONE"]

PREP = """prep AS (SELECT gradient_id, preparation_id, arg_min(target, field_id) FILTER (WHERE target IS NOT NULL) AS target,
  count(*) FILTER (WHERE include_flag=1) AS n_included, count(reference_conc) FILTER (WHERE include_flag=1) AS n_reference_fields, count(ring_count) FILTER (WHERE include_flag=1) AS n_ring_fields,
  avg(reference_conc) FILTER (WHERE include_flag=1) AS mean_reference, stddev_samp(reference_conc) FILTER (WHERE include_flag=1) AS sd_reference,
  avg(ring_count) FILTER (WHERE include_flag=1) AS mean_ring, stddev_samp(ring_count) FILTER (WHERE include_flag=1) AS sd_ring
  FROM (SELECT *, CASE WHEN field_id%2=1 THEN NULL ELSE reference_conc END AS target FROM v_calibration) GROUP BY 1,2),
full_prep AS (SELECT *, n_included=5 AND n_reference_fields=5 AND n_ring_fields=5 AS complete FROM prep),
p AS (SELECT *, CASE gradient_id WHEN 'C0' THEN 'G0' WHEN 'C1' THEN 'G1' WHEN 'C3' THEN 'G2' WHEN 'C5' THEN 'G3' WHEN 'C7' THEN 'G4' WHEN 'C8' THEN 'G5' END AS g, mean_ring AS x, mean_reference AS y FROM full_prep WHERE complete)"""
LINE = """l AS (SELECT count(*) AS n, avg(x) AS xb, avg(y) AS yb, regr_sxx(y,x) AS sxx, regr_syy(y,x) AS sst, regr_slope(y,x) AS slope, regr_intercept(y,x) AS intercept FROM p),
e AS (SELECT p.*, l.*, y-(intercept+slope*x) AS res FROM p, l),
f AS (SELECT n, xb, sxx, sst, slope, intercept, sum(res*res) AS sse, avg(abs(res)) AS mae, sqrt(sum(res*res)/(n-2)) AS se FROM e GROUP BY n, xb, sxx, sst, slope, intercept)"""
# Large-sample expansion of the 0.975 quantile of Student's t around the normal quantile.
Z = "1.959963984540054E0"
T = f"({Z}+({Z}**3+{Z})/(4.0E0*(n-2))+(5*{Z}**5+16*{Z}**3+3*{Z})/(96.0E0*(n-2)**2)+(3*{Z}**7+19*{Z}**5+17*{Z}**3-15*{Z})/(384.0E0*(n-2)**3)+(79*{Z}**9+776*{Z}**7+1482*{Z}**5-1920*{Z}**3-945*{Z})/(92160.0E0*(n-2)**4.0E0))"


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({expr},{digits})+0.0E0 AS {name or expr}"


def fields(v):
    return v.calibration().withColumn("target", F.when(F.col("field_id") % 2 == 0, F.col("reference_conc")))


def mapped(v):
    return G.map_gradients(G.preparations(fields(v)))


@query(
    "g1_preparations",
    f"""WITH {PREP} SELECT gradient_id, preparation_id, {r('target')}, n_included, n_reference_fields, n_ring_fields, {r('mean_reference')}, {r('sd_reference')}, {r('mean_ring')}, {r('sd_ring')}, complete FROM full_prep""",
)
def g1(v):
    return tidy(G.preparations(fields(v)))


@query(
    "g2_preparation_status",
    f"""WITH {PREP} SELECT gradient_id, preparation_id, complete, CASE WHEN complete THEN 'Included' WHEN n_reference_fields=5 AND n_ring_fields=0 THEN 'Excluded: ring counts missing'
    ELSE 'Excluded: paired measurements incomplete' END AS analysis_status FROM full_prep""",
)
def g2(v):
    prep = G.preparation_status(G.preparations(fields(v)))
    return tidy(prep.select("gradient_id", "preparation_id", "complete", "analysis_status"))


@query("g3_map_gradients", f"WITH {PREP} SELECT gradient_id AS source_gradient_id, g AS gradient_id, preparation_id FROM p")
def g3(v):
    return tidy(mapped(v).select("source_gradient_id", "gradient_id", "preparation_id"))


@query(
    "g4_gradients",
    f"""WITH {PREP} SELECT g AS gradient_id, count(*) AS n_preparations, {r('avg(y)', 'mean_reference')}, {r('stddev_samp(y)', 'sd_reference')}, {r('avg(x)', 'mean_ring')}, {r('stddev_samp(x)', 'sd_ring')} FROM p GROUP BY g""",
)
def g4(v):
    return tidy(G.gradients(mapped(v)))


OLS_COLUMNS = "n slope intercept r2 adjusted_r2 rmse mae residual_se slope_se intercept_se t_crit slope_ci_low slope_ci_high intercept_ci_low intercept_ci_high".split()
OLS_SQL = f"""ols AS (SELECT n, slope, intercept, 1-sse/sst AS r2, 1-(sse/sst)*(n-1)/(n-2) AS adjusted_r2, sqrt(sse/n) AS rmse, mae, se AS residual_se, se/sqrt(sxx) AS slope_se,
  se*sqrt(1.0E0/n+xb*xb/sxx) AS intercept_se, {T} AS t_crit, slope-{T}*se/sqrt(sxx) AS slope_ci_low, slope+{T}*se/sqrt(sxx) AS slope_ci_high,
  intercept-{T}*se*sqrt(1.0E0/n+xb*xb/sxx) AS intercept_ci_low, intercept+{T}*se*sqrt(1.0E0/n+xb*xb/sxx) AS intercept_ci_high FROM f)"""


@query("g5_ols", f"WITH {PREP}, {LINE}, {OLS_SQL} SELECT n, {', '.join(r(c, digits=4) for c in OLS_COLUMNS[1:])} FROM ols")
def g5(v):
    return tidy(G.ols(mapped(v), X, Y).select(*OLS_COLUMNS), 4)


@query(
    "g5_ols_by_gradient",
    f"""WITH {PREP}, l AS (SELECT g, count(*) AS n, regr_slope(y,x) AS slope, regr_intercept(y,x) AS intercept FROM p GROUP BY g),
    e AS (SELECT g, n, slope, intercept, y-(intercept+slope*x) AS res FROM p JOIN l USING(g))
    SELECT g AS gradient_id, n, {r('slope', digits=4)}, {r('intercept', digits=4)}, {r('sqrt(sum(res*res)/n)', 'rmse', 4)} FROM e GROUP BY g, n, slope, intercept""",
)
def g5_by(v):
    return tidy(G.ols(mapped(v), X, Y, ["gradient_id"]).select("gradient_id", "n", "slope", "intercept", "rmse"), 4)


@query(
    "g6_leave_one_out",
    f"""WITH {PREP}, {LINE} SELECT preparation_id, {r('intercept+slope*x', 'fitted', 4)}, {r('res', 'residual', 4)}, {r('y-res/(1-(1.0E0/n+(x-xb)*(x-xb)/sxx))', 'loo_prediction', 4)},
    {r('res/(1-(1.0E0/n+(x-xb)*(x-xb)/sxx))', 'loo_residual', 4)} FROM e""",
)
def g6(v):
    out = G.leave_one_out(mapped(v), X, Y)
    return tidy(out.select("preparation_id", "fitted", "residual", "loo_prediction", "loo_residual"), 4)


LOO_SQL = "lo AS (SELECT *, res/(1-(1.0E0/n+(x-xb)*(x-xb)/sxx)) AS lr FROM e), loo AS (SELECT sqrt(avg(lr*lr)) AS loo_rmse, avg(abs(lr)) AS loo_mae, 1-sum(lr*lr)/max(sst) AS loo_r2 FROM lo)"


@query(
    "g6_leave_one_out_scores",
    f"WITH {PREP}, {LINE}, {LOO_SQL} SELECT {r('loo_rmse', digits=4)}, {r('loo_mae', digits=4)}, {r('loo_r2', digits=4)} FROM loo",
)
def g6_scores(v):
    return tidy(G.leave_one_out_scores(G.leave_one_out(mapped(v), X, Y), Y), 4)


BOOT_SQL = """rk AS (SELECT g, x, y, row_number() OVER (PARTITION BY g ORDER BY preparation_id)-1 AS pick FROM p),
sz AS (SELECT g, count(*) AS m FROM p GROUP BY g),
dr AS (SELECT i AS iteration, g, CAST('0x'||substr(sha1('2026|'||CAST(i AS VARCHAR)||'|'||g||'|'||CAST(j AS VARCHAR)),1,8) AS BIGINT)%m AS pick FROM (SELECT g, m, unnest(range(m)) AS j FROM sz), range(200) a(i)),
bt AS (SELECT iteration, regr_slope(y,x) AS slope, regr_intercept(y,x) AS intercept FROM dr JOIN rk USING(g,pick) GROUP BY iteration)"""


@query(
    "g7_stratified_bootstrap",
    f"""WITH {PREP}, {BOOT_SQL} SELECT count(*) AS iterations, count(*) FILTER (WHERE slope IS NULL) AS degenerate,
    {', '.join(r(f'quantile_cont({c},{q}E0)', f'{c}_ci_{s}', 4) for c in ('slope', 'intercept') for s, q in (('low', 0.025), ('high', 0.975)))} FROM bt""",
)
def g7(v):
    return tidy(G.stratified_bootstrap_hashed(mapped(v), X, Y, "gradient_id", "preparation_id", 200), 4)


@query("g7_stratified_bootstrap_full")
def g7_full(v):
    return tidy(G.stratified_bootstrap(mapped(v), X, Y, "gradient_id", "preparation_id"), 4)


@query(
    "g8_curve",
    f"""WITH {PREP}, {LINE}, b AS (SELECT greatest(0.0E0,min(x)-1) AS lo, max(x)+2 AS hi FROM p), c AS (SELECT i AS point, lo+(hi-lo)*i/239 AS gx, f.* FROM b, f, range(240) r(i)),
    d AS (SELECT *, intercept+slope*gx AS fit, {T}*se*sqrt(1.0E0/n+(gx-xb)*(gx-xb)/sxx) AS hm, {T}*se*sqrt(1.0E0+1.0E0/n+(gx-xb)*(gx-xb)/sxx) AS hp FROM c)
    SELECT point, {r('gx', 'x', 4)}, {r('fit', 'fitted', 4)}, {r('fit-hm', 'confidence_low', 4)}, {r('fit+hm', 'confidence_high', 4)}, {r('fit-hp', 'prediction_low', 4)}, {r('fit+hp', 'prediction_high', 4)} FROM d""",
)
def g8(v):
    return tidy(G.curve(mapped(v), X, Y), 4)


RANK_SQL = """rx AS (SELECT x, y, rank() OVER (ORDER BY x)+(count(*) OVER (PARTITION BY x)-1)/2.0E0 AS a, rank() OVER (ORDER BY y)+(count(*) OVER (PARTITION BY y)-1)/2.0E0 AS b FROM p),
co AS (SELECT count(*) AS n, corr(x,y) AS pearson_r, corr(a,b) AS spearman_rho FROM rx)"""


@query(
    "g9_correlations",
    f"WITH {PREP}, {RANK_SQL} SELECT n, {r('pearson_r')}, {r('spearman_rho')} FROM co",
)
def g9(v):
    return tidy(G.correlations(mapped(v), X, Y).select("n", "pearson_r", "spearman_rho"))


@query("g9_correlation_p_values")
def g9_p_values(v):
    return tidy(G.correlations(mapped(v), X, Y))


ORIGIN_SQL = "os AS (SELECT sum(x*y)/sum(x*x) AS s FROM p), og AS (SELECT max(s) AS slope, sqrt(avg((y-s*x)**2)) AS rmse, avg(abs(y-s*x)) AS mae, 1-sum((y-s*x)**2)/regr_syy(y,y) AS centered_r2 FROM p, os)"


@query("g10_origin_fit", f"WITH {PREP}, {ORIGIN_SQL} SELECT {', '.join(r(c, digits=4) for c in ('slope', 'rmse', 'mae', 'centered_r2'))} FROM og")
def g10(v):
    return tidy(G.origin_fit(mapped(v), X, Y), 4)


MELTED = "slope intercept r2 adjusted_r2 rmse mae residual_se".split()


@query(
    "g11_metric_table",
    f"""WITH {PREP}, {LINE}, {OLS_SQL}, {LOO_SQL}, {RANK_SQL}, {ORIGIN_SQL}, {BOOT_SQL}, bs AS (SELECT quantile_cont(slope,0.025E0) AS a, quantile_cont(slope,0.975E0) AS b FROM bt)
    SELECT metric, round(value,4)+0.0E0 AS value FROM (SELECT 'n_preparations' AS metric, n::DOUBLE AS value FROM ols
    {' '.join(f"UNION ALL SELECT '{m}', {m} FROM ols" for m in MELTED)}
    UNION ALL SELECT 'loo_r2', loo_r2 FROM loo UNION ALL SELECT 'pearson_r', pearson_r FROM co UNION ALL SELECT 'spearman_rho', spearman_rho FROM co
    UNION ALL SELECT 'origin_slope', slope FROM og UNION ALL SELECT 'slope_boot_low', a FROM bs UNION ALL SELECT 'slope_boot_high', b FROM bs)""",
)
def g11(v):
    wanted = ["n_preparations", *MELTED, "loo_r2", "pearson_r", "spearman_rho", "origin_slope", "slope_boot_low", "slope_boot_high"]
    row = G.calibration_metrics(mapped(v), 200, bootstrap=G.stratified_bootstrap_hashed).select(*wanted)
    return tidy(G.melt_metrics(row), 4)


@query("g11_metric_table_full")
def g11_full(v):
    return tidy(G.melt_metrics(G.calibration_metrics(mapped(v))), 4)


def labelled(v):
    """Detections with a class label; every seventh field has none."""
    names = F.array(*[F.lit(l) for l in LABELS[:5]])
    return v.detections().filter("field_id % 7 <> 0").select("field_id", names[(F.col("det_id") % 5).cast("int")].alias("label"))


LABEL_SQL = """lab AS (SELECT field_id, ['CMB','DQB','DWB','WQ','YMXB'][det_id%5+1] AS label FROM v_detections WHERE field_id%7<>0),
cc AS (SELECT g.field_id, g.label, count(lab.label) AS count FROM (SELECT * FROM (SELECT DISTINCT field_id FROM v_detections), (SELECT unnest(['CMB','DQB','DWB','WQ','YMXB','NONE']) AS label)) g
  LEFT JOIN lab USING(field_id, label) GROUP BY ALL)"""


def counted(v):
    return G.class_counts(labelled(v), v.detections(), LABELS)


@query(
    "g12_concentration",
    f"""WITH {LABEL_SQL}, t AS (SELECT *, CAST(sum(count) OVER (PARTITION BY field_id) AS BIGINT) AS total_count FROM cc)
    SELECT field_id, label, count, total_count, round(CASE WHEN count<=0 THEN 0.0E0 ELSE greatest(0.0E0, 7177.958896475087E0*count+16.595417284901487E0) END,4)+0.0E0 AS concentration,
      round(CASE WHEN total_count<=0 THEN 0.0E0 ELSE greatest(0.0E0, 7177.958896475087E0*total_count+16.595417284901487E0) END,4)+0.0E0 AS total_concentration FROM t""",
)
def g12(v):
    return tidy(G.concentration(counted(v), G.PUBLISHED_SLOPE, G.PUBLISHED_INTERCEPT), 4)


@query(
    "g12_concentration_geometric",
    f"""WITH {LABEL_SQL} SELECT field_id, label, round(CASE WHEN count<=0 THEN 0.0E0 ELSE 1000.0E0/(4.0E0*10.0E0/50.0E0)*count END,4)+0.0E0 AS concentration FROM cc""",
)
def g12_geometric(v):
    out = G.concentration(counted(v), G.geometric_slope(4.0, 10.0, 50.0), 0.0)
    return tidy(out.select("field_id", "label", "concentration"), 4)


@query("g13_class_counts", f"WITH {LABEL_SQL} SELECT field_id, label, count FROM cc")
def g13(v):
    return tidy(counted(v))


@query(
    "g14_field_to_preparation",
    f"SELECT preparation_id, count(ring_count) AS fields, {r('avg(ring_count)', 'mean_ring_count')} FROM v_calibration GROUP BY preparation_id",
)
def g14(v):
    return tidy(G.field_to_preparation(v.calibration(), "ring_count"))


@query(
    "flagship_calibrated_concentration",
    f"""WITH {PREP}, {LINE} SELECT preparation_id, gradient_id, {r('mean_ring')}, {r('mean_reference')}, {r('CASE WHEN x<=0 THEN 0.0E0 ELSE greatest(0.0E0, slope*x+intercept) END', 'concentration', 4)},
    {r('y-res/(1-(1.0E0/n+(x-xb)*(x-xb)/sxx))', 'loo_prediction', 4)} FROM (SELECT * EXCLUDE (gradient_id), g AS gradient_id FROM e)""",
)
def flagship(v):
    """What concentration does the calibration predict for each preparation, and how well?"""
    prep = mapped(v)
    loo = G.leave_one_out(prep, X, Y)
    estimate = F.when(F.col(X) <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.col("fitted")))
    round4 = lambda c: F.round(c, 4) + F.lit(0.0)
    return loo.select(
        "preparation_id",
        "gradient_id",
        (F.round(X, 6) + F.lit(0.0)).alias(X),
        (F.round(Y, 6) + F.lit(0.0)).alias(Y),
        round4(estimate).alias("concentration"),
        round4(F.col("loo_prediction")).alias("loo_prediction"),
    )
