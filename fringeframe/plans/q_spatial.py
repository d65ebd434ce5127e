"""Queries over images and patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from fringeframe.operators import spatial as D
from fringeframe.operators import workflow as W
from fringeframe.operators.calibrate import PUBLISHED_INTERCEPT, PUBLISHED_SLOPE
from fringeframe.plans.registry import query, tidy
from fringeframe.plans.views import CUBE_BANDS, SIDE, WAVELENGTH_START

BINS = 4
PICKED = [1, 4, 7]
WAVELENGTHS = [WAVELENGTH_START + i for i in range(CUBE_BANDS)]
BIN_SQL = "CAST(least(3, floor(sqrt((y-3.5E0)*(y-3.5E0)+(x-3.5E0)*(x-3.5E0))/(sqrt(24.5E0)+1.0E-6)*4)) AS BIGINT)"


def r(expr: str, name: str | None = None) -> str:
    return f"round({expr},6)+0.0E0 AS {name or expr}"


def long_pixels(images, *keep):
    """Pixels of result images as (keep..., y, x, value)."""
    return tidy(D.explode_pixels(images.select(*keep, "height", "width", "pixels"), name="value").select(*keep, "y", "x", "value"))


def long_profile(df, *keep):
    return tidy(df.select(*keep, F.posexplode("profile").alias("bin", "value")))


@query(
    "d1_radial_bins",
    f"""WITH g AS (SELECT DISTINCT y, x FROM v_pixels), b AS (SELECT {BIN_SQL} AS bin, count(*) AS n FROM g GROUP BY 1)
    SELECT 8::BIGINT AS height, 8::BIGINT AS width, i AS bin, coalesce(n,1) AS pixels, round((i+0.5E0)*(sqrt(24.5E0)+1.0E-6)/4,6)+0.0E0 AS center_px FROM range(4) q(i) LEFT JOIN b ON b.bin=i""",
)
def d1(v):
    return tidy(D.radial_bins(v.images(), BINS))


PROFILE = f"pf AS (SELECT cube_id, class_index, band, {BIN_SQL} AS bin, avg(intensity) AS m FROM {{src}} GROUP BY ALL)"


@query("d2_radial_profile", f"WITH {PROFILE.format(src='v_pixels')} SELECT cube_id, band, bin, {r('m', 'value')} FROM pf")
def d2(v):
    return long_profile(D.radial_profile(v.images(), BINS, False), "cube_id", "band")


@query(
    "d2_radial_profile_normalised",
    f"WITH {PROFILE.format(src='v_pixels')} SELECT cube_id, band, bin, round(m/CASE WHEN max(abs(m)) OVER w>0 THEN max(abs(m)) OVER w ELSE 1.0E0 END,6)+0.0E0 AS value FROM pf WINDOW w AS (PARTITION BY cube_id, band)",
)
def d2_normalised(v):
    return long_profile(D.radial_profile(v.images(), BINS, True), "cube_id", "band")


@query(
    "d3_fit_template",
    """SELECT c.cube_id, c.band, ty AS y, tx AS x, round(coalesce(p.intensity,0.0E0),6)+0.0E0 AS value FROM (SELECT DISTINCT cube_id, band FROM v_pixels) c, range(6) a(ty), range(11) b(tx)
    LEFT JOIN v_pixels p ON p.cube_id=c.cube_id AND p.band=c.band AND p.y=ty+1 AND p.x=tx-1""",
)
def d3(v):
    return long_pixels(D.fit_template(v.images(), 6, 11), "cube_id", "band")


@query(
    "d4_crop_rois",
    """WITH det AS (SELECT DISTINCT cube_id, cube_id*10+k AS det_id, 2+(cube_id+k)%5 AS cx, 2+(cube_id*3+k)%5 AS cy FROM v_pixels, range(2) q(k))
    SELECT det_id, band, y-(cy-2) AS y, x-(cx-2) AS x, round(CASE WHEN (y-cy)*(y-cy)+(x-cx)*(x-cx)<=4 THEN intensity ELSE 0.0E0 END,6)+0.0E0 AS value
    FROM v_pixels JOIN det USING(cube_id) WHERE y BETWEEN cy-2 AND cy+1 AND x BETWEEN cx-2 AND cx+1""",
)
def d4(v):
    c, k = F.col("cube_id"), F.col("k")
    det = v.images().select("cube_id").distinct().withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "cube_id", (c * 10 + k).alias("det_id"), (2 + (c + k) % 5).alias("x"), (2 + (c * 3 + k) % 5).alias("y")
    )
    return long_pixels(D.crop_rois(v.images(), det, "cube_id", 4, True), "det_id", "band")


@query(
    "d5_resize_nearest",
    """WITH i AS (SELECT k, CAST(round_even(k*7/4.0E0,0) AS BIGINT) AS s FROM range(5) q(k)) SELECT cube_id, band, a.k AS y, b.k AS x, round(intensity,6)+0.0E0 AS value FROM v_pixels p JOIN i a ON a.s=p.y JOIN i b ON b.s=p.x""",
)
def d5(v):
    return long_pixels(D.resize_nearest(v.images(), SIDE, SIDE, 5), "cube_id", "band")


STRETCH = """st AS (SELECT *, CASE WHEN hi<=lo THEN CASE WHEN mx<=mn THEN 0.0E0 ELSE greatest(0.0E0,least(1.0E0,(v-mn)/(mx-mn))) END ELSE greatest(0.0E0,least(1.0E0,(v-lo)/(hi-lo))) END AS s FROM (
  SELECT *, quantile_cont(v,{lo}) OVER w AS lo, quantile_cont(v,{hi}) OVER w AS hi, min(v) OVER w AS mn, max(v) OVER w AS mx FROM ({src}) WINDOW w AS (PARTITION BY {keys})))"""


@query(
    "d6_robust_stretch",
    f"WITH {STRETCH.format(lo='0.01E0', hi='0.995E0', src='SELECT cube_id, band, y, x, intensity AS v FROM v_pixels', keys='cube_id, band')} SELECT cube_id, band, y, x, floor(s*255.0E0)+0.0E0 AS value FROM st",
)
def d6(v):
    stretched = D.robust_stretch(F.col("pixels"), 1.0, 99.5, as_byte=True)
    return long_pixels(v.images().withColumn("pixels", stretched), "cube_id", "band")


NORM = "nm AS (SELECT quantile_cont(intensity,0.005E0) AS lo, quantile_cont(intensity,0.995E0) AS hi FROM v_pixels), np AS (SELECT cube_id, class_index, band, y, x, intensity AS raw, greatest(0.0E0,least(1.0E0,(intensity-lo)/(hi-lo))) AS intensity FROM v_pixels, nm)"


@query("d7_fit_normaliser", f"WITH {NORM} SELECT {r('lo', 'low')}, {r('hi', 'high')} FROM nm")
def d7(v):
    return tidy(D.fit_normaliser(v.images()))


@query(
    "d7_fit_normaliser_sampled",
    """WITH i AS (SELECT DISTINCT cube_id, band FROM v_pixels), d AS (SELECT cube_id, band, CAST('0x'||substr(sha1('2026|'||CAST(cube_id AS VARCHAR)||'|'||CAST(band AS VARCHAR)||'|'||CAST(k AS VARCHAR)),1,8) AS BIGINT)%64 AS pos FROM i, range(1,21) q(k)),
    s AS (SELECT intensity AS v FROM d JOIN v_pixels p ON p.cube_id=d.cube_id AND p.band=d.band AND p.y*8+p.x=d.pos)
    SELECT round(quantile_cont(v,0.005E0),6)+0.0E0 AS low, round(quantile_cont(v,0.995E0),6)+0.0E0 AS high FROM s""",
)
def d7_sampled(v):
    return tidy(D.fit_normaliser_drawn(v.images(), 20))


@query("d7_normalise", f"WITH {NORM} SELECT cube_id, band, y, x, {r('intensity', 'value')} FROM np")
def d7_normalise(v):
    return long_pixels(D.normalise(v.images(), D.fit_normaliser(v.images())), "cube_id", "band")


@query("d7_denormalise", f"WITH {NORM} SELECT cube_id, band, y, x, round(greatest(0.0E0, np.intensity*(hi-lo)+lo),6)+0.0E0 AS value FROM np, nm")
def d7_denormalise(v):
    fit = D.fit_normaliser(v.images())
    return long_pixels(D.denormalise(D.normalise(v.images(), fit), fit), "cube_id", "band")


def gradient_sql(src: str, keys: str) -> str:
    side = lambda a, o: f"CASE WHEN {a}=0 THEN lead(v) OVER {o}-v WHEN {a}=7 THEN v-lag(v) OVER {o} ELSE (lead(v) OVER {o}-lag(v) OVER {o})/2.0E0 END"
    return f"SELECT {keys}, y, x, sqrt(gx*gx+gy*gy) AS v FROM (SELECT {keys}, y, x, {side('x', 'wx')} AS gx, {side('y', 'wy')} AS gy FROM {src} WINDOW wx AS (PARTITION BY {keys}, y ORDER BY x), wy AS (PARTITION BY {keys}, x ORDER BY y))"


@query(
    "d8_gradient_magnitude",
    f"WITH s AS (SELECT cube_id, band, y, x, intensity AS v FROM v_pixels), g AS ({gradient_sql('s', 'cube_id, band')}) SELECT cube_id, band, y, x, {r('v', 'value')} FROM g",
)
def d8(v):
    grad = D.gradient_magnitude(F.col("pixels"), F.col("height"), F.col("width"))
    return long_pixels(v.images().withColumn("pixels", grad), "cube_id", "band")


@query(
    "d9_pseudo_channels",
    f"""WITH {STRETCH.format(lo='0.01E0', hi='0.99E0', src='SELECT cube_id, y, x, intensity AS v FROM v_pixels WHERE band=4', keys='cube_id')}, c1 AS (SELECT cube_id, y, x, s AS v FROM st),
    m AS (SELECT cube_id, y, x, avg(intensity) AS v FROM v_pixels WHERE band IN (0,2,4,7,9) GROUP BY ALL),
    {STRETCH.format(lo='0.01E0', hi='0.99E0', src='SELECT * FROM m', keys='cube_id').replace('st AS', 'st2 AS', 1)}, c2 AS (SELECT cube_id, y, x, s AS v FROM st2),
    g AS ({gradient_sql('c2', 'cube_id')}), {STRETCH.format(lo='0.01E0', hi='0.99E0', src='SELECT * FROM g', keys='cube_id').replace('st AS', 'st3 AS', 1)}
    SELECT c1.cube_id, c1.y, c1.x, {r('c1.v', 'channel_1')}, {r('c2.v', 'channel_2')}, {r('st3.s', 'channel_3')} FROM c1 JOIN c2 USING(cube_id, y, x) JOIN st3 USING(cube_id, y, x)""",
)
def d9(v):
    ch = D.pseudo_channels(v.images(), 4, CUBE_BANDS, 5)
    zipped = F.arrays_zip("channel_1", "channel_2", "channel_3")
    long = ch.select("cube_id", F.posexplode(zipped).alias("i", "c"))
    return tidy(long.select("cube_id", F.floor(F.col("i") / SIDE).alias("y"), (F.col("i") % SIDE).alias("x"), "c.*"))


@query("d10_pca_first_component")
def d10(v):
    return long_pixels(D.pca_first_component(v.images()), "cube_id")


@query(
    "d11_image_stats",
    f"""SELECT cube_id, class_index, band, {r('avg(intensity)', 'mean')}, {r('stddev_pop(intensity)', 'sd')}, {r('quantile_cont(intensity,0.1E0)', 'p10')}, {r('quantile_cont(intensity,0.9E0)', 'p90')},
    {r('max(intensity) FILTER (WHERE y=4 AND x=4)', 'center')} FROM v_pixels GROUP BY 1,2,3""",
)
def d11(v):
    return tidy(D.image_stats(v.images()))


@query("d11_cube_stats", f"SELECT cube_id, class_index, {r('avg(intensity)', 'cube_mean')}, {r('stddev_pop(intensity)', 'cube_sd')} FROM v_pixels GROUP BY 1,2")
def d11_cube(v):
    return tidy(D.cube_stats(v.images()))


def feature_sql(src: str, order: str, stats: bool) -> str:
    out = f"""nz AS (SELECT cube_id, band, coalesce(avg(intensity) FILTER (WHERE intensity>0), avg(intensity)) AS v FROM {src} GROUP BY 1,2),
    se AS (SELECT *, {order} AS o FROM nz WHERE {order} IS NOT NULL),
    f1 AS (SELECT cube_id, o AS position, (v-avg(v) OVER w)/(stddev_pop(v) OVER w+1.0E-6) AS value FROM se WINDOW w AS (PARTITION BY cube_id)),
    pf AS (SELECT cube_id, {order} AS o, {BIN_SQL} AS bin, avg(intensity) AS m FROM {src} WHERE {order} IS NOT NULL GROUP BY ALL),
    f2 AS (SELECT cube_id, 3+o*4+bin AS position, m/CASE WHEN max(abs(m)) OVER w>0 THEN max(abs(m)) OVER w ELSE 1.0E0 END AS value FROM pf WINDOW w AS (PARTITION BY cube_id, o))"""
    if stats:
        out += f""", a AS (SELECT cube_id, avg(v) AS s0, stddev_pop(v) AS s1, quantile_cont(v,0.1E0) AS s2, quantile_cont(v,0.9E0) AS s3 FROM nz GROUP BY 1),
    b AS (SELECT cube_id, avg(intensity) AS s4, stddev_pop(intensity) AS s5 FROM {src} GROUP BY 1),
    f3 AS (SELECT cube_id, 15+k AS position, [s0,s1,s2,s3,s4,s5][k+1] AS value FROM a JOIN b USING(cube_id), range(6) q(k))"""
    union = " UNION ALL ".join(f"SELECT cube_id, CAST(position AS BIGINT) AS position, round(value,6)+0.0E0 AS value FROM {t}" for t in ["f1", "f2"] + ["f3"] * stats)
    return f"WITH {out} {union}"


def long_features(df):
    """One row per feature that the cube has; the places of missing bands have none."""
    return tidy(df.select("cube_id", F.posexplode("features").alias("position", "value")).filter("value IS NOT NULL"))


@query("d12_features", feature_sql("v_pixels", "CASE band WHEN 1 THEN 0 WHEN 4 THEN 1 WHEN 7 THEN 2 END", True))
def d12(v):
    return long_features(D.features(v.images(), PICKED, BINS))


@query(
    "d12_features_spectral",
    "WITH nz AS (SELECT cube_id, band, coalesce(avg(intensity) FILTER (WHERE intensity>0), avg(intensity)) AS v FROM v_pixels WHERE band IN (1,4,7) GROUP BY 1,2) SELECT cube_id, (band-1)//3 AS position, round((v-avg(v) OVER w)/(stddev_pop(v) OVER w+1.0E-6),6)+0.0E0 AS value FROM nz WINDOW w AS (PARTITION BY cube_id)",
)
def d12_spectral(v):
    return long_features(D.features(v.images(), PICKED, BINS, "spectral"))


# A wavelength between two bands needs both frames of the cube.
MIXED = """(SELECT a.cube_id, o AS band, a.y, a.x, a.intensity*(1.0E0-w)+b.intensity*w AS intensity FROM (VALUES (0,1,2,0.5E0),(1,4,4,0.0E0),(2,7,8,0.25E0)) t(o,lo,hi,w)
    JOIN v_pixels a ON a.band=t.lo JOIN v_pixels b ON b.cube_id=a.cube_id AND b.band=t.hi AND b.y=a.y AND b.x=a.x)"""


@query("d13_features_selected_only", feature_sql(MIXED, "band", False))
def d13(v):
    nm = [WAVELENGTH_START + 1.5, WAVELENGTH_START + 4.0, WAVELENGTH_START + 7.25]
    axis = (WAVELENGTH_START, WAVELENGTH_START + CUBE_BANDS - 1, CUBE_BANDS)
    return long_features(D.features_selected_only(v.images(), nm, axis, BINS))


def h(tag: str) -> str:
    return f"CAST('0x'||substr(sha1('5|'||CAST(class_index AS VARCHAR)||'|'||CAST(item AS VARCHAR)||'|{tag}'),1,8) AS BIGINT)"


def u(tag: str) -> str:
    return f"(({h(tag)}+0.5E0)/4294967296.0E0)"


def n(tag: str) -> str:
    return f"(sqrt(-2.0E0*ln({u(tag + '|r')}))*cos(2.0E0*pi()*{u(tag + '|a')}))"


@query(
    "d14_augment",
    f"""WITH c AS (SELECT DISTINCT class_index, cube_id FROM v_pixels), rk AS (SELECT *, row_number() OVER (PARTITION BY class_index ORDER BY cube_id)-1 AS pick FROM c),
    sz AS (SELECT class_index, count(*) AS m FROM c GROUP BY 1),
    pl AS (SELECT class_index, item, {h('source')}%m AS pick, {h('turn')}%4 AS turn, {u('mirror')}<0.5E0 AS mirror, {u('flip')}<0.5E0 AS flip, {u('shift')}*4.0E0-2.0E0 AS shift, {n('gain')}*0.06E0+1.0E0 AS gain, {n('offset')} AS off FROM sz, range(1,4) q(item)),
    pp AS (SELECT pl.*, cube_id FROM pl JOIN rk USING(class_index, pick)),
    g AS (SELECT *, b AS band, ry AS y, rx AS x, CASE WHEN flip THEN 7-ry ELSE ry END AS fy, CASE WHEN mirror THEN 7-rx ELSE rx END AS fx, greatest(0.0E0,least(9.0E0,b-shift)) AS src FROM pp, range(10) a(b), range(8) bb(ry), range(8) cc(rx)),
    s AS (SELECT *, CASE turn WHEN 0 THEN fy WHEN 1 THEN fx WHEN 2 THEN 7-fy ELSE 7-fx END AS sy, CASE turn WHEN 0 THEN fx WHEN 1 THEN 7-fy WHEN 2 THEN 7-fx ELSE fy END AS sx FROM g),
    o AS (SELECT s.class_index, item, s.cube_id, s.band, s.y, s.x, off, gain*(p.intensity*(1.0E0-(src-floor(src)))+q.intensity*(src-floor(src))) AS v FROM s
      JOIN v_pixels p ON p.cube_id=s.cube_id AND p.band=floor(src) AND p.y=sy AND p.x=sx JOIN v_pixels q ON q.cube_id=s.cube_id AND q.band=least(9,floor(src)+1) AND q.y=sy AND q.x=sx)
    SELECT class_index, item, cube_id, band, y, x, round(greatest(0.0E0, v+off*0.008E0*greatest(1.0E0, stddev_pop(v) OVER (PARTITION BY class_index, item))),6)+0.0E0 AS value FROM o""",
)
def d14(v):
    return long_pixels(D.augment(v.images(), 3, 5, CUBE_BANDS, noise=0.0), "class_index", "item", "cube_id", "band")


@query("d14_augment_noise")
def d14_noise(v):
    return long_pixels(D.augment(v.images(), 3, 5, CUBE_BANDS), "class_index", "item", "cube_id", "band")


REFERENCE = f"""sb AS (SELECT cube_id, class_index, band, avg(intensity) AS v FROM np GROUP BY 1,2,3), rs AS (SELECT class_index, band, avg(v) AS mean, sqrt(greatest(var_pop(v),1.0E-6)) AS sd FROM sb GROUP BY 1,2),
ec AS (SELECT cube_id, class_index, avg(intensity) AS v FROM np GROUP BY 1,2), re AS (SELECT class_index, avg(v) AS mean, sqrt(greatest(var_pop(v),1.0E-6)) AS sd FROM ec GROUP BY 1),
{PROFILE.format(src='np')}, rr AS (SELECT class_index, band, bin, avg(m) AS mean, sqrt(greatest(var_pop(m),1.0E-6)) AS sd FROM pf GROUP BY 1,2,3)"""


def scaled(v):
    return D.normalise(v.images(), D.fit_normaliser(v.images()))


@query(
    "d15_physics_reference",
    f"""WITH {NORM}, {REFERENCE} SELECT 'spectrum' AS part, class_index, band, NULL::BIGINT AS bin, {r('mean')}, {r('sd')} FROM rs UNION ALL SELECT 'energy', class_index, NULL, NULL, round(mean,6)+0.0E0, round(sd,6)+0.0E0 FROM re
    UNION ALL SELECT 'radial', class_index, band, bin, round(mean,6)+0.0E0, round(sd,6)+0.0E0 FROM rr""",
)
def d15(v):
    by_band, energy, radial = D.physics_reference(scaled(v), BINS)
    none = lambda: F.lit(None).cast("bigint")
    columns = ["part", "class_index", "band", "bin", "mean", "sd"]
    parts = [
        by_band.withColumn("part", F.lit("spectrum")).withColumn("bin", none()),
        energy.withColumn("part", F.lit("energy")).withColumn("band", none()).withColumn("bin", none()),
        radial.withColumn("part", F.lit("radial")).withColumn("bin", F.col("bin").cast("bigint")),
    ]
    out = parts[0].select(*columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(*columns))
    return tidy(out)


RESCALED = """pa AS (SELECT cube_id, class_index, band, bin, greatest(0.0E0,least(2.9999E0, bin*sqrt((411.0E0+band)/415.5E0))) AS src FROM pf),
ra AS (SELECT a.cube_id, a.class_index, a.band, a.bin, l.m*(1.0E0-(src-floor(src)))+r.m*(src-floor(src)) AS v FROM pa a JOIN pf l ON l.cube_id=a.cube_id AND l.band=a.band AND l.bin=floor(src) JOIN pf r ON r.cube_id=a.cube_id AND r.band=a.band AND r.bin=least(3,floor(src)+1))"""
NAMES = ["range_score", "spectral_smooth", "spatial_tv", "energy", "class_spectrum", "radial_reference", "fresnel_scaling"]


@query(
    "d16_physics_scores",
    f"""WITH {NORM}, {REFERENCE}, {RESCALED},
    w AS (SELECT *, lag(intensity) OVER b AS pb, lead(intensity) OVER b AS nb, lead(intensity) OVER sx AS nx, lead(intensity) OVER sy AS ny FROM np WINDOW b AS (PARTITION BY cube_id,y,x ORDER BY band), sx AS (PARTITION BY cube_id,band,y ORDER BY x), sy AS (PARTITION BY cube_id,band,x ORDER BY y)),
    a AS (SELECT cube_id, avg(greatest(-intensity,0.0E0)**2)+avg(greatest(intensity-1,0.0E0)**2) AS range_score, avg((nb-2*intensity+pb)**2) AS spectral_smooth, avg((nx-intensity)**2)+avg((ny-intensity)**2) AS spatial_tv FROM w GROUP BY 1),
    b AS (SELECT cube_id, avg(((v-mean)/greatest(sd*2.5E0,0.03E0))**2) AS class_spectrum FROM sb JOIN rs USING(class_index,band) GROUP BY 1),
    c AS (SELECT cube_id, ((v-mean)/greatest(sd*2.5E0,0.02E0))**2 AS energy FROM ec JOIN re USING(class_index)),
    d AS (SELECT cube_id, avg(((m-mean)/greatest(sd*3.0E0,0.035E0))**2) AS radial_reference FROM pf JOIN rr USING(class_index,band,bin) GROUP BY 1),
    f AS (SELECT cube_id, avg((nv-2*v+pv)**2) AS fresnel_scaling FROM (SELECT *, lag(v) OVER q AS pv, lead(v) OVER q AS nv FROM ra WINDOW q AS (PARTITION BY cube_id,bin ORDER BY band)) GROUP BY 1)
    SELECT cube_id, {', '.join(r(x) for x in NAMES)}, round(0.05E0*range_score+0.08E0*spectral_smooth+0.02E0*spatial_tv+0.04E0*energy+0.04E0*class_spectrum+0.03E0*radial_reference+0.08E0*fresnel_scaling,6)+0.0E0 AS total
    FROM a JOIN b USING(cube_id) JOIN c USING(cube_id) JOIN d USING(cube_id) JOIN f USING(cube_id)""",
)
def d16(v):
    return tidy(D.physics_scores(scaled(v), WAVELENGTHS, BINS).select("cube_id", *NAMES, "total"))


@query("d17_radial_rescale", f"WITH {PROFILE.format(src='v_pixels')}, {RESCALED} SELECT cube_id, band, bin, {r('v', 'value')} FROM ra")
def d17(v):
    profiles = D.radial_profile(v.images(), BINS, False)
    scale = F.sqrt((F.lit(WAVELENGTH_START) + F.col("band")) / F.lit(WAVELENGTH_START + (CUBE_BANDS - 1) / 2.0))
    return long_profile(profiles.withColumn("profile", D.radial_rescale(F.col("profile"), scale)), "cube_id", "band")


@query(
    "d18_geometry_report",
    f"""SELECT {r('100*1.4E0', 'crop_width_um')}, {r('100*1.4E0', 'crop_height_um')}, {r('min(sqrt(wavelength_nm*1.0E-9*0.005E0)/1.4E-6)', 'fresnel_length_px_min')}, {r('max(sqrt(wavelength_nm*1.0E-9*0.005E0)/1.4E-6)', 'fresnel_length_px_max')},
    {', '.join(r(f'({k}.0E0*1.0E-6)**2/(avg(wavelength_nm*1.0E-9)*0.005E0)', f'fresnel_number_radius_{k}um') for k in (5, 25, 50))} FROM (SELECT DISTINCT band, wavelength_nm FROM v_spectra)""",
)
def d18(v):
    bands = v.spectra().select(F.posexplode("spectrum").alias("band", "_v")).select("band").distinct()
    return tidy(D.geometry_report(bands.withColumn("wavelength_nm", WAVELENGTH_START + F.col("band")), 100, 100))


@query(
    "d19_cube_manifest",
    f"""WITH {NORM}, sb AS (SELECT cube_id, class_index, band, avg(intensity) AS v FROM np GROUP BY 1,2,3), cm AS (SELECT class_index, band, avg(v) AS mu FROM sb GROUP BY 1,2),
    cs AS (SELECT cube_id, sum(v*mu)/(sqrt(sum(v*v))*sqrt(sum(mu*mu))) AS cosine FROM sb JOIN cm USING(class_index,band) GROUP BY 1),
    st AS (SELECT cube_id, class_index, avg(intensity) AS cube_mean, stddev_pop(intensity) AS cube_sd, min(raw) AS min_raw, max(raw) AS max_raw FROM np GROUP BY 1,2)
    SELECT cube_id, class_index, {', '.join(r(x) for x in ('cube_mean', 'cube_sd', 'cosine', 'min_raw', 'max_raw'))} FROM st JOIN cs USING(cube_id)""",
)
def d19(v):
    return tidy(D.cube_manifest(v.images(), D.fit_normaliser(v.images())))


@query(
    "d20_ring_support",
    """WITH e AS (SELECT CAST(sample_id//64 AS BIGINT) AS patch_id, sample_id%64 AS y, band AS x, abs(intensity) AS e FROM v_spectra),
    p AS (SELECT e.*, sqrt((y-31.5E0)**2+(x-31.5E0)**2) AS r, floor((atan2(y-31.5E0,x-31.5E0)+pi())/(pi()/12)) AS s FROM e WHERE patch_id IN (SELECT patch_id FROM e GROUP BY 1 HAVING count(*)=4096)),
    pr AS (SELECT patch_id, floor(r) AS k, avg(e) AS m FROM p WHERE floor(r) BETWEEN 7 AND 25 GROUP BY 1,2), se AS (SELECT patch_id, s, avg(e) AS m FROM p WHERE r BETWEEN 7 AND 25 GROUP BY 1,2),
    a AS (SELECT patch_id, stddev_pop(m)/(avg(m)+1.0E-6) AS osc, quantile_cont(m,0.9E0)/(quantile_cont(m,0.35E0)+1.0E-6) AS peak FROM pr GROUP BY 1),
    b AS (SELECT patch_id, quantile_cont(m,0.25E0)/(quantile_cont(m,0.75E0)+1.0E-6) AS bal FROM se GROUP BY 1),
    c AS (SELECT patch_id, avg(e) FILTER (WHERE r BETWEEN 7 AND 25)/(avg(e) FILTER (WHERE r BETWEEN 26 AND 30)+1.0E-6) AS ratio FROM p GROUP BY 1)
    SELECT patch_id, round(coalesce(osc*bal*peak*least(greatest(ratio,0.0E0),2.5E0),0.0E0),6)+0.0E0 AS support FROM (SELECT DISTINCT patch_id FROM e) LEFT JOIN a USING(patch_id) LEFT JOIN b USING(patch_id) LEFT JOIN c USING(patch_id)""",
)
def d20(v):
    rows = v.spectra().groupBy(F.floor(F.col("sample_id") / 64).cast("bigint").alias("patch_id")).agg(
        F.sort_array(F.collect_list(F.struct("sample_id", "spectrum"))).alias("_r")
    )
    energy = F.flatten(F.transform("_r", lambda s: F.transform(s["spectrum"], lambda x: F.abs(x))))
    return tidy(D.ring_support(rows.select("patch_id", energy.alias("energy")), 64))


# Raw detections of the 8x8 frames (six a field) and a linear model over three bands.
RAW = """raw AS (SELECT cube_id AS field_id, cube_id*10+k AS det_id, (1+(cube_id+k*2)%6)::DOUBLE AS x, (2+(cube_id*3+k)%6)::DOUBLE AS y, 0.15E0+0.13E0*((cube_id+k)%6) AS box_conf, 0.9E0-0.02E0*k AS kp_conf FROM (SELECT DISTINCT cube_id FROM v_pixels), range(6) q(k))"""
MODEL_MEAN, MODEL_SCALE, MODEL_INTERCEPTS = [0.1, -0.2, 0.05], [1.5, 0.5, 1.0], [0.0, 0.1, -0.1, 0.05]
MODEL_COEFFICIENTS = [[1.0, 0.5, -0.5], [-1.0, 0.25, 0.75], [0.5, -1.0, 0.5], [-0.25, 0.5, -1.0]]
MEASURED_LABELS = ["G0", "G1", "G2", "G3"]


def _measured_sql() -> str:
    weights = ", ".join(f"({k}, {i}, {w}E0, {MODEL_MEAN[i]}E0, {MODEL_SCALE[i]}E0)" for k, row in enumerate(MODEL_COEFFICIENTS) for i, w in enumerate(row))
    names = ", ".join(f"({k}, '{name}', {MODEL_INTERCEPTS[k]}E0)" for k, name in enumerate(MEASURED_LABELS))
    line = lambda c: f"round(CASE WHEN {c}<=0 THEN 0.0E0 ELSE 7177.958896475087E0*{c}+16.595417284901487E0 END,4)+0.0E0"
    return f"""WITH RECURSIVE {RAW}, ac AS (SELECT field_id, det_id, x, y, least(box_conf,kp_conf) AS joint FROM raw WHERE least(box_conf,kp_conf)>=0.25E0 AND x>=2 AND y>=2 AND x<=6 AND y<=6),
    so AS (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY joint DESC, det_id) AS k FROM ac),
    sg(field_id, k, kept) AS (SELECT field_id, 0::BIGINT, []::STRUCT(x DOUBLE, y DOUBLE, id BIGINT)[] FROM so GROUP BY 1 UNION ALL
      SELECT sg.field_id, so.k, CASE WHEN len(list_filter(kept, lambda p: (p.x-so.x)*(p.x-so.x)+(p.y-so.y)*(p.y-so.y)<4))=0 THEN list_append(kept, {{'x': so.x, 'y': so.y, 'id': so.det_id}}) ELSE kept END FROM sg JOIN so ON so.field_id=sg.field_id AND so.k=sg.k+1),
    sp AS (SELECT field_id, p.id AS det_id, p.x AS cx, p.y AS cy FROM (SELECT field_id, unnest(kept) AS p FROM (SELECT field_id, arg_max(kept, k) AS kept FROM sg GROUP BY 1))),
    px AS (SELECT field_id, det_id, (band-1)//3 AS i, CASE WHEN (y-cy)*(y-cy)+(x-cx)*(x-cx)<=4 THEN intensity ELSE 0.0E0 END AS v FROM v_pixels JOIN sp ON cube_id=field_id WHERE band IN (1,4,7) AND y BETWEEN cy-2 AND cy+1 AND x BETWEEN cx-2 AND cx+1),
    nz AS (SELECT field_id, det_id, i, coalesce(avg(v) FILTER (WHERE v>0), avg(v)) AS v FROM px GROUP BY ALL),
    ft AS (SELECT field_id, det_id, i, (v-avg(v) OVER w)/(stddev_pop(v) OVER w+1.0E-6) AS v FROM nz WINDOW w AS (PARTITION BY field_id, det_id)),
    sc AS (SELECT field_id, det_id, k, sum(w*(v-m)/s) AS s FROM ft JOIN (VALUES {weights}) t(k,i,w,m,s) USING(i) GROUP BY ALL),
    nm(k, label, b) AS (VALUES {names}), pr AS (SELECT field_id, det_id, arg_max(label, s+b) AS label FROM sc JOIN nm USING(k) GROUP BY ALL),
    cc AS (SELECT f.field_id, nm.label, count(pr.det_id) AS count FROM (SELECT DISTINCT cube_id AS field_id FROM v_pixels) f CROSS JOIN nm LEFT JOIN pr ON pr.field_id=f.field_id AND pr.label=nm.label GROUP BY ALL),
    t AS (SELECT *, CAST(sum(count) OVER (PARTITION BY field_id) AS BIGINT) AS total_count FROM cc)
    SELECT field_id, label, count, total_count, {line('count')} AS concentration, {line('total_count')} AS total_concentration FROM t"""


@query("m1_measure_fields", _measured_sql())
def measured(v):
    """How many particles of each class does every field hold, and what concentrations are these?"""
    frames = v.images().withColumnRenamed("cube_id", "field_id")
    k = F.col("k")
    raw = frames.select("field_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))).select(
        "field_id",
        (F.col("field_id") * 10 + k).alias("det_id"),
        (1 + (F.col("field_id") + k * 2) % 6).cast("double").alias("x"),
        (2 + (F.col("field_id") * 3 + k) % 6).cast("double").alias("y"),
        (0.15 + 0.13 * ((F.col("field_id") + k) % 6)).alias("box_conf"),
        (0.9 - 0.02 * k).alias("kp_conf"),
    )
    rows = [(MODEL_MEAN, MODEL_SCALE, list(range(len(MEASURED_LABELS))), MODEL_COEFFICIENTS, MODEL_INTERCEPTS)]
    model = v.spark.createDataFrame(rows, "mean array<double>, scale array<double>, classes array<bigint>, coefficients array<array<double>>, intercepts array<double>")
    out = W.measure_fields(
        frames, raw, model, MEASURED_LABELS, PICKED, BINS, PUBLISHED_SLOPE, PUBLISHED_INTERCEPT,
        crop=4, spacing=2.0, size=(SIDE, SIDE), variant="spectral", tile=3,
    )
    return tidy(out, 4)
