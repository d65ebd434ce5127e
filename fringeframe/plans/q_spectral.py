"""Queries over spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from fringeframe.functions import arrays as A
from fringeframe.operators import spectral as S
from fringeframe.plans.registry import query, tidy
from fringeframe.plans.views import BANDS, WAVELENGTH_START

CLASSES = [0, 1, 2, 3, 4]


def long_of(df, *keep, value="spectrum", name="value"):
    """Exploded result rows, band as BIGINT."""
    return tidy(S.explode_spectra(df.select(*keep, value), value, name))


def axis_column(df):
    return F.transform("spectrum", lambda _v, i: WAVELENGTH_START + i.cast("double"))


@query(
    "c1_wavelength_axis",
    """SELECT scan_id, position, row_number() OVER w-1 AS band_index, round(CASE WHEN n<2 THEN 400.0E0 ELSE 400.0E0+(row_number() OVER w-1)*400.0E0/(n-1) END,6)+0.0E0 AS wavelength_nm
    FROM (SELECT *, count(*) OVER (PARTITION BY scan_id) AS n FROM v_frames WHERE captured) WINDOW w AS (PARTITION BY scan_id ORDER BY position)""",
)
def c1(v):
    frames = v.frames().filter("captured").select("scan_id", "position")
    return tidy(S.wavelength_axis(frames, 400.0, 800.0))


@query(
    "c2_nearest_band",
    """SELECT sample_id, arg_min(band, abs(wavelength_nm-(430.0E0+sample_id%20+0.3E0))*1000000+band) AS band FROM v_spectra GROUP BY sample_id""",
)
def c2(v):
    target = F.lit(430.0) + F.col("sample_id") % 20 + F.lit(0.3)
    spectra = v.spectra()
    return tidy(spectra.select("sample_id", S.nearest_band(axis_column(spectra), target).alias("band")))


@query(
    "c3_band_subset",
    "SELECT sample_id, band, round(intensity,6)+0.0E0 AS intensity FROM v_spectra WHERE band IN (SELECT DISTINCT CAST(round_even(i*63/23.0E0,0) AS BIGINT) FROM range(24) r(i))",
)
def c3(v):
    picked = v.spectra().select("sample_id", F.explode(S.band_subset(F.col("spectrum"), BANDS, 24)).alias("b"))
    return tidy(picked.select("sample_id", "b.*"))


@query(
    "c4_resample",
    """WITH g AS (SELECT i AS band, greatest(0.0E0, least(63.0E0, 405.0E0+1.7E0*i-411.0E0)) AS pos FROM range(45) r(i))
    SELECT a.sample_id, g.band, round(a.intensity*(1.0E0-(pos-floor(pos)))+b.intensity*(pos-floor(pos)),6)+0.0E0 AS value
    FROM g JOIN v_spectra a ON a.band=floor(pos) JOIN v_spectra b ON b.sample_id=a.sample_id AND b.band=ceil(pos)""",
)
def c4(v):
    grid = [405.0 + 1.7 * i for i in range(45)]
    return long_of(v.spectra().withColumn("spectrum", S.resample(F.col("spectrum"), WAVELENGTH_START, 1.0, grid)), "sample_id")


@query(
    "c4_resample_uneven",
    """WITH s AS (SELECT sample_id, band, 411.0E0+band+0.004E0*band*band AS w, intensity, lead(411.0E0+(band)+0.004E0*(band)*(band)) OVER (PARTITION BY sample_id ORDER BY band) AS w1,
      lead(intensity) OVER (PARTITION BY sample_id ORDER BY band) AS v1 FROM v_spectra), g AS (SELECT i AS band, 412.0E0+2.0E0*i AS gx FROM range(30) r(i))
    SELECT sample_id, g.band, round(intensity+(v1-intensity)*(gx-w)/(w1-w),6)+0.0E0 AS value FROM g JOIN s ON gx>=w AND gx<w1""",
)
def c4_uneven(v):
    wavelengths = F.transform("spectrum", lambda _v, i: WAVELENGTH_START + i + 0.004 * i * i)
    grid = [412.0 + 2.0 * i for i in range(30)]
    return long_of(v.spectra().withColumn("spectrum", S.resample_uneven(F.col("spectrum"), wavelengths, grid)), "sample_id")


@query(
    "c5_shift_bands",
    """SELECT a.sample_id, a.band, round(b.intensity,6)+0.0E0 AS value FROM v_spectra a LEFT JOIN v_spectra b ON a.sample_id=b.sample_id AND b.band=a.band-(a.sample_id%7-3)""",
)
def c5(v):
    shifted = S.shift_bands(F.col("spectrum"), (F.col("sample_id") % 7 - 3).cast("int"))
    return long_of(v.spectra().withColumn("spectrum", shifted), "sample_id")


@query(
    "c6_shift_fractional",
    """WITH p AS (SELECT sample_id, band, greatest(0.0E0,least(63.0E0,band-((sample_id%9)*0.45E0-1.8E0))) AS pos FROM v_spectra)
    SELECT p.sample_id, p.band, round(a.intensity*(1.0E0-(pos-floor(pos)))+b.intensity*(pos-floor(pos)),6)+0.0E0 AS value FROM p
    JOIN v_spectra a ON a.sample_id=p.sample_id AND a.band=floor(pos) JOIN v_spectra b ON b.sample_id=p.sample_id AND b.band=least(63,floor(pos)+1)""",
)
def c6(v):
    by = (F.col("sample_id") % 9) * 0.45 - 1.8
    return long_of(v.spectra().withColumn("spectrum", S.shift_fractional(F.col("spectrum"), by)), "sample_id")


SHIFTED = "SELECT a.sample_id, a.band, b.intensity AS value FROM v_spectra a LEFT JOIN v_spectra b ON a.sample_id=b.sample_id AND b.band=a.band-(a.sample_id%7-3)"


@query(
    "c7_crop_common",
    f"""WITH s AS ({SHIFTED}), ok AS (SELECT band FROM s GROUP BY band HAVING bool_and(value IS NOT NULL)) SELECT sample_id, band, round(value,6)+0.0E0 AS value FROM s WHERE band IN (SELECT band FROM ok)""",
)
def c7(v):
    moved = v.spectra().withColumn("shift", (F.col("sample_id") % 7 - 3).cast("int"))
    moved = moved.withColumn("spectrum", S.shift_bands(F.col("spectrum"), F.col("shift")))
    cropped = S.explode_spectra(S.crop_common(moved, "shift").select("sample_id", "first_band", "spectrum"), name="value")
    return tidy(cropped.select("sample_id", (F.col("band") + F.col("first_band")).alias("band"), "value"))


@query("c8_apply_shift_report", f"SELECT sample_id, band, round(value,6)+0.0E0 AS value FROM ({SHIFTED})")
def c8(v):
    report = v.spectra().select("sample_id", (F.col("sample_id") % 7 - 3).cast("int").alias("shift_bands"))
    return long_of(S.apply_shift_report(v.spectra(), report), "sample_id")


@query(
    "c9_nonzero_mean",
    "SELECT cube_id, band, round(coalesce(avg(intensity) FILTER (WHERE intensity>0), avg(intensity)),6)+0.0E0 AS value FROM v_pixels GROUP BY 1,2",
)
def c9(v):
    return long_of(S.cube_spectra(v.images()), "cube_id")


@query(
    "c10_count_nonzero_mean",
    "SELECT cube_id, band, round(coalesce(sum(v)/nullif(count(*) FILTER (WHERE v<>0),0), avg(v)),6)+0.0E0 AS value FROM (SELECT *, CASE WHEN x=3 THEN -intensity ELSE intensity END AS v FROM v_pixels) GROUP BY 1,2",
)
def c10(v):
    signed = F.transform("pixels", lambda p, i: F.when(i % F.col("width") == 3, -p).otherwise(p))
    return long_of(S.cube_spectra(v.images().withColumn("pixels", signed), S.count_nonzero_mean), "cube_id")


@query("c11_mean_spectrum", "SELECT cube_id, band, round(avg(intensity),6)+0.0E0 AS value FROM v_pixels GROUP BY 1,2")
def c11(v):
    return long_of(S.cube_spectra(v.images(), A.mean), "cube_id")


@query(
    "c12_snv",
    "SELECT sample_id, band, round((intensity-avg(intensity) OVER w)/(stddev_pop(intensity) OVER w+1.0E-6),6)+0.0E0 AS value FROM v_spectra WINDOW w AS (PARTITION BY sample_id)",
)
def c12(v):
    return long_of(v.spectra().withColumn("spectrum", A.snv(F.col("spectrum"))), "sample_id")


SMOOTH = """SELECT sample_id, band, (sum(intensity) OVER (PARTITION BY sample_id ORDER BY band ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)
  + greatest(0,3-band)*first_value(intensity) OVER (PARTITION BY sample_id ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
  + greatest(0,band-60)*last_value(intensity) OVER (PARTITION BY sample_id ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))/7.0E0 AS value FROM v_spectra"""
GRADIENT = """SELECT sample_id, band, CASE WHEN band=0 THEN lead(value) OVER w-value WHEN band=63 THEN value-lag(value) OVER w ELSE (lead(value) OVER w-lag(value) OVER w)/2.0E0 END AS value
  FROM {src} WINDOW w AS (PARTITION BY sample_id ORDER BY band)"""
ZSCORE = "SELECT sample_id, band, (value-avg(value) OVER w)/CASE WHEN stddev_pop(value) OVER w>0 THEN stddev_pop(value) OVER w ELSE 1.0E0 END AS value FROM {src} WINDOW w AS (PARTITION BY sample_id)"


@query("c13_moving_average", f"SELECT sample_id, band, round(value,6)+0.0E0 AS value FROM ({SMOOTH})")
def c13(v):
    return long_of(v.spectra().withColumn("spectrum", A.moving_average(F.col("spectrum"), 7)), "sample_id")


@query(
    "c14_gradient_zscore",
    f"""WITH s AS (SELECT sample_id, band, intensity AS value FROM v_spectra), g AS ({GRADIENT.format(src='s')}), z AS ({ZSCORE.format(src='g')}) SELECT sample_id, band, round(value,6)+0.0E0 AS value FROM z""",
)
def c14(v):
    return long_of(v.spectra().withColumn("spectrum", A.zscore(A.gradient(F.col("spectrum")))), "sample_id")


PREPARED = f"m AS ({SMOOTH}), g AS ({GRADIENT.format(src='m')}), z AS ({ZSCORE.format(src='g')})"
LAG_PICK = """sc AS (SELECT sample_id, l, sum(p)/count(p) AS score FROM pr GROUP BY 1,2 HAVING count(p)>=20),
best AS (SELECT sample_id, l AS lag FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, l) AS k FROM sc) WHERE k=1)"""


def _lag_sql(max_lag: int) -> str:
    return f"""WITH {PREPARED}, pr AS (SELECT z.sample_id, l, z.value*r.value AS p FROM z, range(-{max_lag},{max_lag + 1}) q(l), z r WHERE r.sample_id=z.sample_id//100*100 AND r.band=z.band+l), {LAG_PICK} SELECT sample_id, lag FROM best"""


def _lags(v, max_lag: int):
    spectra = v.spectra()
    hundred = (F.floor(F.col("sample_id") / 100) * 100).alias("ref_id")
    reference = spectra.select(F.col("sample_id").alias("ref_id"), F.col("spectrum").alias("reference"))
    pairs = spectra.select("sample_id", "spectrum", hundred).join(reference, "ref_id")
    return tidy(pairs.select("sample_id", S.best_lag(F.col("reference"), F.col("spectrum"), max_lag).alias("lag")))


@query("c15_best_lag", _lag_sql(8))
def c15(v):
    return _lags(v, 8)


@query("c15_best_lag_full", _lag_sql(S.MAX_LAG))
def c15_full(v):
    return _lags(v, S.MAX_LAG)


def _align_sql(max_lag: int) -> str:
    return f"""WITH {PREPARED}, md AS (SELECT class_index AS sample_id, band, quantile_cont(intensity,0.5E0) AS intensity FROM v_spectra GROUP BY 1,2),
    rm AS ({SMOOTH.replace('FROM v_spectra', 'FROM md')}), rg AS ({GRADIENT.format(src='rm')}), rz AS ({ZSCORE.format(src='rg')}),
    cl AS (SELECT DISTINCT sample_id, class_index FROM v_spectra),
    pr AS (SELECT z.sample_id, l, z.value*rz.value AS p FROM z JOIN cl USING(sample_id), range(-{max_lag},{max_lag + 1}) q(l), rz WHERE rz.sample_id=cl.class_index AND rz.band=z.band+l), {LAG_PICK},
    sh AS (SELECT sample_id, class_index, lag, -class_index AS extra FROM best JOIN cl USING(sample_id)),
    mv AS (SELECT a.sample_id, a.band, sh.lag+sh.extra AS shift_bands, CASE WHEN a.band-extra>=0 AND a.band-extra<=63 THEN b.intensity END AS v FROM v_spectra a JOIN sh USING(sample_id) LEFT JOIN v_spectra b ON b.sample_id=a.sample_id AND b.band=a.band-extra-lag)
    SELECT sample_id, band, shift_bands, round(v,6)+0.0E0 AS value FROM mv"""


def _aligned(v, max_lag: int):
    aligned = S.align_class(v.spectra(), -F.col("class_index").cast("int"), max_lag=max_lag)
    return long_of(aligned, "sample_id", "shift_bands")


@query("c16_align_class", _align_sql(8))
def c16(v):
    return _aligned(v, 8)


@query("c16_align_class_full", _align_sql(S.MAX_LAG))
def c16_full(v):
    return _aligned(v, S.MAX_LAG)


CV_SQL = "cv AS (SELECT class_index, band, count(*) AS n, avg(intensity) AS mean, stddev_samp(intensity) AS sd, 100.0E0*stddev_samp(intensity)/greatest(abs(avg(intensity)),2.220446049250313E-16) AS cv FROM (SELECT sample_id, class_index, band, intensity+1.0E0 AS intensity FROM v_spectra) GROUP BY 1,2)"


def lifted(v):
    return v.spectra().withColumn("spectrum", F.transform("spectrum", lambda x: x + 1.0))


@query(
    "c17_class_cv",
    f"WITH {CV_SQL} SELECT class_index, band, n, round(mean,6)+0.0E0 AS mean, round(sd,6)+0.0E0 AS sd, round(cv,6)+0.0E0 AS cv FROM cv",
)
def c17(v):
    return tidy(S.class_cv(lifted(v)))


@query(
    "c18_cv_quantiles",
    f"""WITH {CV_SQL} SELECT class_index, round(min(cv),6)+0.0E0 AS cv_min, round(max(cv),6)+0.0E0 AS cv_max,
    {', '.join(f'round(quantile_cont(cv,{p}E0),6)+0.0E0 AS cv_p{int(p * 100):02d}' for p in (0.05, 0.25, 0.5, 0.75, 0.95))} FROM cv GROUP BY 1""",
)
def c18(v):
    return tidy(S.cv_quantiles(S.class_cv(lifted(v))))


@query(
    "c19_mean_curves",
    f"SELECT band, {', '.join(f'round(avg(intensity) FILTER (WHERE class_index={c}),6)+0.0E0 AS class_{c}' for c in CLASSES)} FROM v_spectra GROUP BY band",
)
def c19(v):
    return tidy(S.mean_curves(v.spectra(), CLASSES))


@query("c19_curve_agreement", "SELECT DISTINCT band, band%8<>3 AS agrees FROM v_spectra")
def c19_agreement(v):
    curves = S.mean_curves(v.spectra(), CLASSES)
    archived = curves.withColumn("class_2", F.when(F.col("band") % 8 == 3, F.col("class_2") * 1.1).otherwise(F.col("class_2")))
    return tidy(S.curve_agreement(curves, archived, CLASSES, 1e-9))


@query(
    "c20_cosine_to_class",
    """WITH m AS (SELECT class_index, band, avg(intensity) AS mu FROM v_spectra GROUP BY 1,2)
    SELECT sample_id, round(CASE WHEN sqrt(sum(intensity*intensity))*sqrt(sum(mu*mu))<=1.0E-12 THEN 0.0E0 ELSE sum(intensity*mu)/(sqrt(sum(intensity*intensity))*sqrt(sum(mu*mu))) END,6)+0.0E0 AS cosine
    FROM v_spectra JOIN m USING(class_index, band) GROUP BY sample_id""",
)
def c20(v):
    return tidy(S.cosine_to_class(v.spectra()).select("sample_id", "cosine"))


@query(
    "c21_minmax",
    """SELECT sample_id, band, round(CASE WHEN max(intensity) OVER w>min(intensity) OVER w THEN (intensity-min(intensity) OVER w)/(max(intensity) OVER w-min(intensity) OVER w) ELSE 0.0E0 END,6)+0.0E0 AS value FROM v_spectra WINDOW w AS (PARTITION BY sample_id)""",
)
def c21(v):
    return long_of(v.spectra().withColumn("spectrum", A.minmax(F.col("spectrum"))), "sample_id")
