"""Queries that score and select bands, and model queries on spectra."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from fringeframe.operators import bands as B
from fringeframe.operators import kernels as K
from fringeframe.operators import ml as M
from fringeframe.operators.settle import settled
from fringeframe.plans.registry import query, tidy
from fringeframe.plans.views import BANDS, CLASS_COUNT, WAVELENGTH_START

CLASSES = list(range(CLASS_COUNT))

ANOVA = """cb AS (SELECT band, class_index, count(*) AS n, avg(intensity) AS m, var_pop(intensity) AS v FROM v_spectra GROUP BY 1,2),
gb AS (SELECT band, sum(n*m)/sum(n) AS g, sum(n) AS total, count(*) AS k, sum(n*v) AS within FROM cb GROUP BY 1),
an AS (SELECT band, (sum(n*(m-g)*(m-g))/max(k-1))/(max(within)/max(total-k)) AS score FROM cb JOIN gb USING(band) GROUP BY band)"""


def r(expr: str, name: str | None = None) -> str:
    return f"round({expr},6)+0.0E0 AS {name or expr}"


def mm(expr: str, over: str = "") -> str:
    return f"(({expr})-min({expr}) OVER ({over}))/(max({expr}) OVER ({over})-min({expr}) OVER ({over}))"


@query("e1_anova_f", f"WITH {ANOVA} SELECT band, {r('score')} FROM an")
def e1(v):
    return tidy(B.anova_f(v.spectra()))


@query("e1_anova_scaled", f"WITH {ANOVA} SELECT band, {r(mm('score'), 'score')} FROM an")
def e1_scaled(v):
    return tidy(B.scaled_scores(B.anova_f(v.spectra())))


PSI = "(list_sum(list_transform(range(1,{x}), lambda i: 1.0E0/i))-0.5772156649015329E0)"


@query(
    "e2_mutual_info",
    f"""WITH nn AS (SELECT a.band, a.sample_id, a.class_index, a.intensity AS x, b.intensity AS nb, abs(b.intensity-a.intensity) AS d, row_number() OVER (PARTITION BY a.band, a.sample_id ORDER BY abs(b.intensity-a.intensity), b.intensity) AS k
      FROM v_spectra a JOIN v_spectra b ON a.band=b.band AND a.class_index=b.class_index AND a.sample_id<>b.sample_id),
    rd AS (SELECT band, sample_id, class_index, x, nb, d FROM nn WHERE k=3), nc AS (SELECT class_index, count(*) AS nc FROM v_spectra WHERE band=0 GROUP BY 1),
    mm AS (SELECT rd.band, rd.sample_id, rd.class_index, count(*) AS m FROM rd JOIN v_spectra b ON b.band=rd.band AND CASE WHEN d=0 THEN b.intensity=x ELSE b.intensity<CASE WHEN nb>x THEN nb ELSE x+d END AND b.intensity>CASE WHEN nb<x THEN nb ELSE x-d END END GROUP BY ALL),
    pc AS (SELECT class_index, coalesce({PSI.format(x='nc')},-0.5772156649015329E0) AS psi FROM nc)
    SELECT band, round(greatest(0.0E0, (SELECT {PSI.format(x='count(*)')} FROM v_spectra WHERE band=0)+(1.5E0-0.5772156649015329E0)-avg(psi)-avg(coalesce({PSI.format(x='m')},-0.5772156649015329E0))),6)+0.0E0 AS score
    FROM mm JOIN pc USING(class_index) GROUP BY band""",
)
def e2(v):
    return tidy(B.mutual_info(v.spectra()))


@query("e3_rf_importance")
def e3(v):
    return tidy(B.rf_importance(v.spectra(), 50))


@query("e4_pls_vip")
def e4(v):
    return tidy(B.scaled_scores(B.pls_vip(v.spectra(), CLASSES)))


@query(
    "e5_gram",
    """WITH c AS (SELECT sample_id, class_index, band, intensity-avg(intensity) OVER (PARTITION BY band) AS v FROM v_spectra)
    SELECT a.band AS band_i, b.band AS band_j, round(sum(a.v*b.v),6)+0.0E0 AS g FROM c a JOIN c b USING(sample_id) GROUP BY 1,2""",
)
def e5_gram(v):
    g = B.gram(v.spectra(), CLASSES).filter(F.col("i").between(1, BANDS) & F.col("j").between(1, BANDS))
    return tidy(g.select((F.col("i") - 1).alias("band_i"), (F.col("j") - 1).alias("band_j"), "g"))


@query("e5_spa_rank")
def e5(v):
    return tidy(B.spa_rank(v.spectra(), CLASSES))


@query(
    "e6_relieff",
    """WITH st AS (SELECT band, CASE WHEN stddev_pop(intensity)=0 THEN 1.0E0 ELSE stddev_pop(intensity) END AS sd, CASE WHEN max(intensity)=min(intensity) THEN 1.0E0 ELSE max(intensity)-min(intensity) END AS rg FROM v_spectra GROUP BY 1),
    pk AS (SELECT sample_id, class_index FROM v_spectra WHERE band=0 ORDER BY sha1('2026|'||CAST(sample_id AS VARCHAR)), sample_id LIMIT 200),
    ds AS (SELECT p.sample_id AS q, p.class_index AS qc, b.sample_id AS t, b.class_index AS tc, sqrt(sum(((a.intensity-b.intensity)/sd)**2)) AS d FROM pk p JOIN v_spectra a USING(sample_id) JOIN v_spectra b ON b.band=a.band AND b.sample_id<>p.sample_id JOIN st ON st.band=a.band GROUP BY ALL),
    nr AS (SELECT *, count(*) OVER (PARTITION BY q, tc) AS f FROM (SELECT *, row_number() OVER (PARTITION BY q, tc ORDER BY d, t) AS k FROM ds) WHERE k<=10),
    pr AS (SELECT class_index, count(*)/(SELECT count(*) FROM v_spectra WHERE band=0)::DOUBLE AS p FROM v_spectra WHERE band=0 GROUP BY 1)
    SELECT a.band, round(greatest(0.0E0, sum(CASE WHEN qc=tc THEN -1.0E0 ELSE x.p/(1.0E0-y.p) END/f/200.0E0*abs(a.intensity-b.intensity)/rg)),6)+0.0E0 AS score
    FROM nr JOIN v_spectra a ON a.sample_id=q JOIN v_spectra b ON b.sample_id=t AND b.band=a.band JOIN st ON st.band=a.band JOIN pr x ON x.class_index=tc JOIN pr y ON y.class_index=qc GROUP BY a.band""",
)
def e6(v):
    return tidy(B.relieff(v.spectra()))


COS = f"""cm AS (SELECT class_index AS c, band, avg(intensity) AS m FROM v_spectra GROUP BY 1,2), dy AS (SELECT c, band, m-avg(m) OVER (PARTITION BY band) AS d FROM cm),
tu AS (SELECT a.c, a.band, sum(CASE WHEN a.c=b.c THEN 0.0E0 ELSE b.d/(pi()*(b.c-a.c)) END) AS n FROM dy a JOIN dy b USING(band) GROUP BY 1,2),
sy AS (SELECT a.band, b.band AS other, sum(a.d*b.d)/4.0E0 AS s FROM dy a JOIN dy b USING(c) GROUP BY 1,2), asy AS (SELECT a.band, b.band AS other, sum(a.n*b.d)/4.0E0 AS s FROM tu a JOIN dy b USING(c) GROUP BY 1,2),
pt AS (SELECT band, abs(max(s) FILTER (WHERE band=other)) AS dg, sum(abs(s)) AS sc FROM sy GROUP BY 1), pa AS (SELECT band, sum(abs(s)) AS ac FROM asy GROUP BY 1),
co AS (SELECT band, 0.5E0*{mm('dg')}+0.3E0*{mm('sc-dg')}+0.2E0*{mm('ac')} AS score FROM pt JOIN pa USING(band))"""


@query("e7_two_d_cos", f"WITH {COS} SELECT band, {r('score')} FROM co")
def e7(v):
    return tidy(B.two_d_cos(v.spectra()))


def with_nm(scores):
    return scores.withColumn("wavelength_nm", F.lit(WAVELENGTH_START) + F.col("band"))


@query(
    "e8_select_min_gap",
    f"""WITH RECURSIVE {ANOVA}, o AS (SELECT band, row_number() OVER (ORDER BY score DESC, band) AS k FROM an),
    g(k, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT o.k, CASE WHEN len(kept)<8 AND len(list_filter(kept, lambda b: abs(b-o.band)<5))=0 THEN list_append(kept, o.band::BIGINT) ELSE kept END FROM g JOIN o ON o.k=g.k+1),
    f AS (SELECT kept FROM g ORDER BY k DESC LIMIT 1)
    SELECT i AS rank, kept[i] AS band, 411.0E0+kept[i] AS wavelength_nm FROM f, range(1,9) q(i)""",
)
def e8(v):
    return tidy(B.select_min_gap(with_nm(B.anova_f(v.spectra())), 8, 5.0))


def both_methods(v):
    anova = B.anova_f(v.spectra()).withColumn("method", F.lit("anova"))
    return anova.unionByName(B.two_d_cos(v.spectra()).withColumn("method", F.lit("two_d_cos")))


@query(
    "e9_rank_bands",
    f"""WITH {ANOVA}, {COS}, u AS (SELECT 'anova' AS method, band, score FROM an UNION ALL SELECT 'two_d_cos', band, score FROM co)
    SELECT method, band, {r('score')}, row_number() OVER (PARTITION BY method ORDER BY score DESC, band) AS rank FROM u""",
)
def e9(v):
    return tidy(B.rank_bands(both_methods(v)))


@query("e10_selection_grid")
def e10(v):
    train, test = M.holdout(v.spectra(), F.col("sample_id") % 10 < 3)
    methods = B.anova_f(train).withColumn("method", F.lit("anova")).unionByName(
        B.two_d_cos(train).withColumn("method", F.lit("two_d_cos"))
    )
    rankings = settled(B.rank_bands(methods))
    return tidy(B.selection_grid(train, test, rankings, [5, 10], BANDS, partial(M.fit_predict, "logistic_regression_l2")))


SCALED = "sc AS (SELECT sample_id, class_index, band, (intensity-avg(intensity) OVER w)/CASE WHEN stddev_pop(intensity) OVER w=0 THEN 1.0E0 ELSE stddev_pop(intensity) OVER w END AS z FROM v_spectra WINDOW w AS (PARTITION BY band))"


@query("i1_scale", f"WITH {SCALED} SELECT sample_id, band, {r('z', 'value')} FROM sc")
def i1(v):
    data = M.as_features(v.spectra())
    return tidy(M.scale(data, M.fit_scaler(data)).select("sample_id", F.posexplode("features").alias("band", "value")))


@query(
    "i2_balanced_weights",
    f"SELECT sample_id, class_index, {r('(count(*) OVER ())::DOUBLE/(5*count(*) OVER (PARTITION BY class_index))', 'weight')} FROM v_spectra WHERE band=0",
)
def i2(v):
    return tidy(M.balanced_weights(v.spectra().select("sample_id", "class_index")))


def split(v):
    return M.holdout(M.as_features(v.spectra()), F.col("sample_id") % 10 < 3)


def predicted(v, name):
    train, test = split(v)
    return tidy(M.fit_predict(name, train, test).select("sample_id", "class_index", "predicted_index"))


@query("i3_logistic_regression")
def i3_logistic(v):
    return predicted(v, "logistic_regression_l2")


@query("i3_linear_svm")
def i3_svm(v):
    return predicted(v, "linear_svm")


@query("i3_random_forest")
def i3_forest(v):
    return predicted(v, "random_forest")


@query("i3_gradient_boosting")
def i3_boosting(v):
    return predicted(v, "gradient_boosting")


@query("i4_rbf_classifier")
def i4(v):
    return predicted(v, "svm_rbf")


@query("i4_kernel_residuals")
def i4_residuals(v):
    train, test = split(v)
    scaler = settled(M.fit_scaler(train))
    both = K.nystroem_features(M.scale(train, scaler), M.scale(test, scaler))
    return tidy(both[0].unionByName(both[1]).select("sample_id", "class_index", "residual"))


@query(
    "i5_knn_classify",
    """WITH tr AS (SELECT * FROM v_spectra WHERE sample_id%10>=3), ts AS (SELECT * FROM v_spectra WHERE sample_id%10<3),
    st AS (SELECT band, CASE WHEN stddev_pop(intensity)=0 THEN 1.0E0 ELSE stddev_pop(intensity) END AS sd FROM tr GROUP BY 1),
    d AS (SELECT a.sample_id AS q, b.sample_id AS t, b.class_index AS c, sqrt(sum(((a.intensity-b.intensity)/sd)**2)) AS d FROM ts a JOIN tr b USING(band) JOIN st USING(band) GROUP BY ALL),
    n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, t) AS k FROM d) WHERE k<=5),
    w AS (SELECT q, c, sum(CASE WHEN z THEN CASE WHEN d=0 THEN 1.0E0 ELSE 0.0E0 END ELSE 1.0E0/d END) AS w FROM (SELECT *, bool_or(d=0) OVER (PARTITION BY q) AS z FROM n) GROUP BY 1,2)
    SELECT q AS sample_id, (SELECT any_value(class_index) FROM ts WHERE ts.sample_id=q) AS class_index, c AS predicted_index FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY w DESC, c) AS k FROM w) WHERE k=1""",
)
def i5(v):
    return predicted(v, "knn_5")


@query("i6_mlp")
def i6(v):
    return predicted(v, "tiny_mlp")


@query("i7_scenario_grid")
def i7(v):
    train, test = split(v)
    shifted = train.withColumn("features", F.transform("features", lambda x: x * 1.05)).withColumn(
        "sample_id", -F.col("sample_id") - 1
    )
    scenarios = {"real": M.classical_domain(train, None), "real_plus_classical": M.classical_domain(train, shifted)}
    return tidy(M.scenario_metrics(M.scenario_grid(scenarios, test, ["logistic_regression_l2", "knn_5"])))


CENTROID = f"""{SCALED.replace('v_spectra WINDOW', 'v_spectra WHERE sample_id%10>=3 WINDOW')}, tst AS (SELECT band, avg(intensity) AS mu, CASE WHEN stddev_pop(intensity)=0 THEN 1.0E0 ELSE stddev_pop(intensity) END AS sd FROM v_spectra WHERE sample_id%10>=3 GROUP BY 1),
ce AS (SELECT class_index AS c, band, avg(z) AS m FROM sc GROUP BY 1,2), b0 AS (SELECT c, -0.5E0*sum(m*m) AS b FROM ce GROUP BY 1),
sco AS (SELECT sample_id, ce.c, sum((intensity-mu)/sd*m)+max(b) AS s FROM v_spectra JOIN tst USING(band) JOIN ce USING(band) JOIN b0 ON b0.c=ce.c GROUP BY 1,2),
pred AS (SELECT sample_id, arg_max(c, s) AS predicted_index, max(s)-max(s, 2)[2] AS margin FROM sco GROUP BY 1)"""


def scored(v):
    train, _test = split(v)
    return M.score_linear(M.as_features(v.spectra()), M.centroid_model(train))


@query("i8_score_linear", f"WITH {CENTROID} SELECT sample_id, predicted_index, {r('margin')} FROM pred")
def i8(v):
    return tidy(scored(v).select("sample_id", "predicted_index", "margin"))


@query("i9_parity_check", f"WITH {CENTROID} SELECT sample_id, CASE WHEN sample_id%50=0 THEN (predicted_index+1)%5 ELSE predicted_index END AS predicted_index FROM pred WHERE sample_id%50=0")
def i9(v):
    fresh = scored(v)
    stored = fresh.withColumn(
        "predicted_index",
        F.when(F.col("sample_id") % 50 == 0, (F.col("predicted_index") + 1) % 5).otherwise(F.col("predicted_index")),
    )
    return tidy(M.parity_check(stored, fresh))


@query("i10_pca2")
def i10(v):
    return tidy(M.pca2(M.as_features(v.spectra())).select("sample_id", "class_index", "pc1", "pc2"))
