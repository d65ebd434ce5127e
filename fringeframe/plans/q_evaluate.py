"""Queries over prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fringeframe.operators import evaluate as E
from fringeframe.plans.registry import query, tidy

LABELS = [0, 1, 2, 3, 4]
GRID_LABELS = [0, 1, 2, 3, 4, 5]

LONG = """SELECT sample_id, cluster_id, true_index, 'a' AS model, pred_a AS predicted_index FROM v_predictions
UNION ALL SELECT sample_id, cluster_id, true_index, 'b', pred_b FROM v_predictions
UNION ALL SELECT sample_id, cluster_id, true_index, 'c', CASE WHEN sample_id%3=0 THEN pred_a ELSE pred_b END FROM v_predictions"""

SEEDED = """SELECT sample_id, true_index, model, seed, CASE WHEN (sample_id+seed*cluster_id)%9=0 THEN (predicted_index+1)%5 ELSE predicted_index END AS predicted_index
FROM lp, range(1,4) r(seed)"""

REPORT = """counts AS (SELECT model, true_index AS t, predicted_index AS p, count(*) AS n FROM lp GROUP BY ALL),
rep AS (SELECT model, label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(support) AS BIGINT) AS support, CAST(sum(predicted) AS BIGINT) AS predicted FROM (
  SELECT model, t AS label, CASE WHEN t=p THEN n ELSE 0 END AS tp, n AS support, 0 AS predicted FROM counts
  UNION ALL SELECT model, p, 0, 0, n FROM counts) GROUP BY model, label),
scored AS (SELECT *, CASE WHEN predicted=0 THEN 0.0E0 ELSE tp/predicted::DOUBLE END AS precision, CASE WHEN support=0 THEN 0.0E0 ELSE tp/support::DOUBLE END AS recall,
  CASE WHEN predicted+support=0 THEN 0.0E0 ELSE 2.0E0*tp/(predicted+support) END AS f1 FROM rep),
met AS (SELECT model, CAST(sum(support) AS BIGINT) AS n, sum(tp)::DOUBLE/sum(support) AS accuracy, avg(recall) FILTER (WHERE support>0) AS balanced_accuracy,
  avg(f1) AS macro_f1, sum(f1*support)/sum(support) AS weighted_f1,
  (sum(tp)::DOUBLE*sum(support)-sum(predicted::DOUBLE*support))/sqrt((sum(support)::DOUBLE*sum(support)-sum(predicted::DOUBLE*predicted))*(sum(support)::DOUBLE*sum(support)-sum(support::DOUBLE*support))) AS mcc
  FROM scored GROUP BY model)"""

MCNEMAR = """least(1.0E0, 2.0E0*list_sum(list_transform(range(0, least(x,y)+1), lambda k: exp(lgamma(x+y+1.0E0)-lgamma(k+1.0E0)-lgamma(x+y-k+1.0E0)-(x+y)*ln(2.0E0)))))"""


def r(name: str) -> str:
    return f"round({name},6)+0.0E0 AS {name}"


def long_predictions(v):
    model = lambda name, c: F.struct(F.lit(name).alias("model"), c.alias("predicted_index"))
    mixed = F.when(F.col("sample_id") % 3 == 0, F.col("pred_a")).otherwise(F.col("pred_b"))
    models = F.array(model("a", F.col("pred_a")), model("b", F.col("pred_b")), model("c", mixed))
    return v.predictions().select("sample_id", "cluster_id", "true_index", F.explode(models).alias("m")).select(
        "sample_id", "cluster_id", "true_index", "m.*"
    )


def seeded_predictions(v):
    p = F.col("predicted_index")
    flip = (F.col("sample_id") + F.col("seed") * F.col("cluster_id")) % 9 == 0
    return long_predictions(v).withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn(
        "predicted_index", F.when(flip, (p + 1) % 5).otherwise(p)
    )


@query(
    "f1_confusion",
    f"""WITH lp AS ({LONG}), g AS (SELECT m.model, t.i AS true_index, p.i AS predicted_index FROM (SELECT DISTINCT model FROM lp) m, range(6) t(i), range(6) p(i))
    SELECT g.model, g.true_index, g.predicted_index, count(lp.sample_id) AS n FROM g LEFT JOIN lp USING(model,true_index,predicted_index) GROUP BY ALL""",
)
def f1(v):
    return tidy(E.confusion(long_predictions(v), ["model"], GRID_LABELS))


@query(
    "f1_confusion_wide",
    f"""WITH lp AS ({LONG}) SELECT model, t.i AS true_index, {', '.join(f'count(*) FILTER (WHERE predicted_index={k} AND true_index=t.i) AS predicted_{k}' for k in LABELS)}
    FROM lp, range(5) t(i) GROUP BY model, t.i""",
)
def f1_wide(v):
    return tidy(E.confusion_wide(E.confusion(long_predictions(v), ["model"], LABELS), ["model"], LABELS))


@query(
    "f2_confusion_rates",
    f"""WITH lp AS ({LONG}), g AS (SELECT m.model, t.i AS true_index, p.i AS predicted_index FROM (SELECT DISTINCT model FROM lp) m, range(6) t(i), range(6) p(i)),
    c AS (SELECT g.model, g.true_index, g.predicted_index, count(lp.sample_id) AS n FROM g LEFT JOIN lp USING(model,true_index,predicted_index) GROUP BY ALL)
    SELECT model, true_index, predicted_index, n, round(CASE WHEN sum(n) OVER w=0 THEN 0.0E0 ELSE n/(sum(n) OVER w)::DOUBLE END,6)+0.0E0 AS rate FROM c WINDOW w AS (PARTITION BY model,true_index)""",
)
def f2(v):
    return tidy(E.confusion_rates(E.confusion(long_predictions(v), ["model"], GRID_LABELS), ["model"]))


METRIC_NAMES = ["accuracy", "balanced_accuracy", "macro_f1", "weighted_f1", "mcc"]


@query("f3_metrics", f"WITH lp AS ({LONG}), {REPORT} SELECT model, n, {', '.join(r(m) for m in METRIC_NAMES)} FROM met")
def f3(v):
    return tidy(E.metrics(long_predictions(v), ["model"]))


@query(
    "f3_metrics_fixed_labels",
    f"WITH lp AS ({LONG}), {REPORT} SELECT met.model, met.n, {', '.join(r(m) for m in METRIC_NAMES if m != 'macro_f1')}, round((SELECT sum(f1) FROM scored s WHERE s.model=met.model AND label IN (0,1,2,9))/4.0E0,6)+0.0E0 AS macro_f1 FROM met",
)
def f3_fixed(v):
    return tidy(E.metrics(long_predictions(v), ["model"], [0, 1, 2, 9]))


@query(
    "f4_class_report",
    f"WITH lp AS ({LONG}), {REPORT} SELECT model, label, tp, support, predicted, {r('precision')}, {r('recall')}, {r('f1')} FROM scored",
)
def f4(v):
    return tidy(E.class_report(long_predictions(v), ["model"]))


PAIRED = f"""lp AS ({LONG}), ok AS (SELECT sample_id, model, CAST(true_index=predicted_index AS INT) AS k FROM lp),
pt AS (SELECT a.model AS model_a, b.model AS model_b, count(*) FILTER (WHERE a.k=1 AND b.k=1) AS both_right, count(*) FILTER (WHERE a.k=0 AND b.k=0) AS both_wrong,
  count(*) FILTER (WHERE a.k=1 AND b.k=0) AS a_only, count(*) FILTER (WHERE a.k=0 AND b.k=1) AS b_only
  FROM ok a JOIN ok b USING(sample_id) WHERE a.model<b.model GROUP BY ALL)"""
PAIRS = [("a", "b"), ("a", "c"), ("b", "c")]


@query("f5_paired_table", f"WITH {PAIRED} SELECT * FROM pt")
def f5(v):
    return tidy(E.paired_tables(long_predictions(v), PAIRS))


DISCORDANT = """d AS (SELECT cluster_id, count(*) FILTER (WHERE pred_a=true_index AND pred_b<>true_index) AS x, count(*) FILTER (WHERE pred_a<>true_index AND pred_b=true_index) AS y
FROM v_predictions GROUP BY cluster_id)"""


def cluster_tests(v):
    right_a, right_b = F.col("pred_a") == F.col("true_index"), F.col("pred_b") == F.col("true_index")
    return (
        v.predictions()
        .groupBy("cluster_id")
        .agg(F.count_if(right_a & ~right_b).alias("a_only"), F.count_if(~right_a & right_b).alias("b_only"))
        .withColumn("p", E.mcnemar_p("a_only", "b_only"))
    )


@query("f6_mcnemar", f"WITH {DISCORDANT} SELECT cluster_id, x AS a_only, y AS b_only, round({MCNEMAR},6)+0.0E0 AS p FROM d")
def f6(v):
    return tidy(cluster_tests(v))


@query(
    "f7_holm",
    f"""WITH {DISCORDANT}, t AS (SELECT cluster_id, round({MCNEMAR},9) AS p FROM d), k AS (SELECT *, row_number() OVER (ORDER BY p, cluster_id) AS rk, count(*) OVER () AS m FROM t),
    h AS (SELECT cluster_id, p, least(1.0E0, max((m-rk+1)*p) OVER (ORDER BY rk)) AS p_holm FROM k)
    SELECT cluster_id, {r('p')}, {r('p_holm')}, p_holm<0.05E0 AS significant FROM h""",
)
def f7(v):
    tests = cluster_tests(v).select("cluster_id", F.round("p", 9).alias("p"))
    return tidy(E.holm(tests, "p", "cluster_id"))


@query("f8_paired_bootstrap")
def f8(v):
    return tidy(E.paired_bootstrap(v.predictions(), "true_index", "pred_a", "pred_b", LABELS, 500))


@query("f8_paired_bootstrap_full")
def f8_full(v):
    return tidy(E.paired_bootstrap(v.predictions(), "true_index", "pred_a", "pred_b", LABELS))


@query("f9_bootstrap_ci")
def f9(v):
    return tidy(E.bootstrap_ci(v.predictions(), "true_index", "pred_a", LABELS, 500))


@query("f9_bootstrap_ci_full")
def f9_full(v):
    return tidy(E.bootstrap_ci(v.predictions(), "true_index", "pred_a", LABELS))


@query(
    "f10_cluster_bootstrap",
    """WITH s AS (SELECT cluster_id, count(*) AS n, count(*) FILTER (WHERE pred_a=true_index) AS ok FROM v_predictions GROUP BY 1),
    k AS (SELECT row_number() OVER (ORDER BY cluster_id)-1 AS pick, n, ok FROM s),
    d AS (SELECT i AS iteration, CAST('0x'||substr(sha1('2026|'||CAST(i AS VARCHAR)||'|'||CAST(j AS VARCHAR)),1,8) AS BIGINT)%(SELECT count(*) FROM s) AS pick
      FROM range(200) a(i), (SELECT unnest(range((SELECT count(*) FROM s))) AS j)),
    a AS (SELECT iteration, sum(ok)::DOUBLE/sum(n) AS acc FROM d JOIN k USING(pick) GROUP BY iteration)
    SELECT count(*) AS iterations, round(quantile_cont(acc,0.025E0),6)+0.0E0 AS accuracy_ci_low, round(quantile_cont(acc,0.975E0),6)+0.0E0 AS accuracy_ci_high,
      round((SELECT sum(ok)::DOUBLE/sum(n) FROM s),6)+0.0E0 AS accuracy FROM a""",
)
def f10(v):
    pred = v.predictions().withColumn("predicted_index", F.col("pred_a"))
    return tidy(E.cluster_bootstrap_hashed(pred, "cluster_id", 200))


@query("f10_cluster_bootstrap_full")
def f10_full(v):
    pred = v.predictions().withColumn("predicted_index", F.col("pred_a"))
    return tidy(E.cluster_bootstrap(pred, "cluster_id"))


@query(
    "f11_majority_vote",
    f"""WITH lp AS ({LONG}), sp AS ({SEEDED}), c AS (SELECT model, sample_id, true_index, predicted_index, count(*) AS n FROM sp GROUP BY ALL)
    SELECT model, sample_id, true_index, predicted_index FROM (SELECT *, row_number() OVER (PARTITION BY model, sample_id ORDER BY n DESC, predicted_index) AS k FROM c) WHERE k=1""",
)
def f11(v):
    return tidy(E.majority_vote(seeded_predictions(v), ["model", "sample_id"]))


@query(
    "f12_seed_summary",
    f"""WITH lp0 AS ({LONG}), sp AS ({SEEDED.replace('FROM lp', 'FROM lp0')}), lp AS (SELECT sample_id, true_index, model||'#'||CAST(seed AS VARCHAR) AS model, predicted_index FROM sp), {REPORT},
    per AS (SELECT split_part(model,'#',1) AS model, accuracy, macro_f1 FROM met),
    su AS (SELECT model, count(*) AS runs, avg(accuracy) AS accuracy_mean, stddev_samp(accuracy) AS accuracy_sd, avg(macro_f1) AS macro_f1_mean, stddev_samp(macro_f1) AS macro_f1_sd FROM per GROUP BY model),
    best AS (SELECT model FROM su ORDER BY macro_f1_mean DESC, accuracy_mean DESC LIMIT 1),
    c AS (SELECT model, sample_id, true_index, predicted_index, count(*) AS n FROM sp GROUP BY ALL),
    vt AS (SELECT model, sample_id, true_index=predicted_index AS k FROM (SELECT *, row_number() OVER (PARTITION BY model, sample_id ORDER BY n DESC, predicted_index) AS q FROM c) WHERE q=1),
    d AS (SELECT v.model, count(*) FILTER (WHERE b.k AND NOT v.k) AS x, count(*) FILTER (WHERE NOT b.k AND v.k) AS y FROM vt v JOIN vt b USING(sample_id) WHERE b.model=(SELECT model FROM best) GROUP BY v.model)
    SELECT model, runs, {r('accuracy_mean')}, {r('accuracy_sd')}, {r('macro_f1_mean')}, {r('macro_f1_sd')}, x AS reference_only, y AS model_only,
      model=(SELECT model FROM best) AS is_reference, round({MCNEMAR},6)+0.0E0 AS p_vs_reference FROM su JOIN d USING(model)""",
)
def f12(v):
    out = E.seed_summary(seeded_predictions(v))
    return tidy(
        out.select(
            "model", "runs", "accuracy_mean", "accuracy_sd", "macro_f1_mean", "macro_f1_sd",
            "reference_only", "model_only", "is_reference", "p_vs_reference",
        )
    )


@query(
    "f13_domain_rank",
    """WITH s AS (SELECT cluster_id, avg(CAST(pred_a=true_index AS INT)) AS sa, avg(CAST(pred_b=true_index AS INT)) AS sb FROM v_predictions GROUP BY 1)
    SELECT cluster_id, round(sa,6)+0.0E0 AS score_a, round(sb,6)+0.0E0 AS score_b, round(CASE WHEN sa+sb=0 THEN 0.0E0 ELSE 2.0E0*sa*sb/(sa+sb) END,6)+0.0E0 AS combined
    FROM s WHERE cluster_id%2=1 ORDER BY CASE WHEN sa+sb=0 THEN 0.0E0 ELSE 2.0E0*sa*sb/(sa+sb) END DESC, sa DESC, cluster_id LIMIT 1""",
)
def f13(v):
    right = lambda c: F.avg((F.col(c) == F.col("true_index")).cast("int"))
    scores = v.predictions().groupBy("cluster_id").agg(right("pred_a").alias("score_a"), right("pred_b").alias("score_b"))
    scores = scores.withColumn("_deployable", F.col("cluster_id") % 2 == 1)
    return tidy(E.domain_rank(scores, "score_a", "score_b", "_deployable", "cluster_id").drop("_deployable"))


@query(
    "f14_end_to_end_f1",
    """WITH s AS (SELECT cluster_id, count(*) FILTER (WHERE pred_a=true_index AND sample_id%4<>0) AS correct, count(*) FILTER (WHERE sample_id%4<>0) AS predicted, count(*) FILTER (WHERE sample_id%7<>0) AS truth FROM v_predictions GROUP BY 1),
    q AS (SELECT *, CASE WHEN predicted=0 THEN 0.0E0 ELSE correct::DOUBLE/predicted END AS precision, CASE WHEN truth=0 THEN 0.0E0 ELSE correct::DOUBLE/truth END AS recall FROM s)
    SELECT cluster_id, round(precision,6)+0.0E0 AS precision, round(recall,6)+0.0E0 AS recall, round(CASE WHEN precision+recall=0 THEN 0.0E0 ELSE 2.0E0*precision*recall/(precision+recall) END,6)+0.0E0 AS f1 FROM q""",
)
def f14(v):
    found = F.col("sample_id") % 4 != 0
    sums = v.predictions().groupBy("cluster_id").agg(
        F.count_if((F.col("pred_a") == F.col("true_index")) & found).alias("correct"),
        F.count_if(found).alias("predicted"),
        F.count_if(F.col("sample_id") % 7 != 0).alias("truth"),
    )
    return tidy(sums.select("cluster_id", *E.end_to_end_f1(F.col("correct"), F.col("predicted"), F.col("truth"))))


@query(
    "f15_deployment_score",
    f"""WITH lp AS ({LONG}), {REPORT}, x AS (SELECT CASE model WHEN 'a' THEN 'linear_svm' WHEN 'b' THEN 'knn_5' ELSE 'random_forest' END AS model, macro_f1, n*0.1E0 AS model_size_kb, n/1000.0E0 AS latency_ms FROM met)
    SELECT model, round(100.0E0*macro_f1+CASE WHEN model='linear_svm' THEN 2.5E0 ELSE 0.0E0 END-0.35E0*ln(1.0E0+model_size_kb)-0.08E0*latency_ms-CASE WHEN model='knn_5' THEN 3.0E0 ELSE 0.0E0 END,6)+0.0E0 AS score FROM x""",
)
def f15(v):
    names = F.create_map(*[F.lit(x) for x in ("a", "linear_svm", "b", "knn_5", "c", "random_forest")])
    models = E.metrics(long_predictions(v), ["model"]).select(
        names[F.col("model")].alias("model"),
        "macro_f1",
        (F.col("n") * 0.1).alias("model_size_kb"),
        (F.col("n") / 1000.0).alias("latency_ms"),
    )
    return tidy(E.deployment_score(models).select("model", "score"))


@query(
    "f16_union_predictions",
    """SELECT 'manual' AS domain, 'manual:'||CAST(sample_id AS VARCHAR) AS sample_key, true_index, pred_a AS predicted_index, cluster_id FROM v_predictions
    UNION ALL SELECT 'fullfield', 'fullfield:'||CAST(sample_id AS VARCHAR), true_index, pred_b, NULL FROM v_predictions""",
)
def f16(v):
    p = v.predictions()
    manual = p.select("sample_id", "true_index", F.col("pred_a").alias("predicted_index"), "cluster_id")
    full = p.select("sample_id", "true_index", F.col("pred_b").alias("predicted_index"))
    return tidy(E.union_predictions({"manual": manual, "fullfield": full}).drop("sample_id"))


@query(
    "f17_wide_predictions",
    "SELECT sample_id, true_index, pred_a AS a, pred_b AS b, CASE WHEN sample_id%3=0 THEN pred_a ELSE pred_b END AS c FROM v_predictions",
)
def f17(v):
    return tidy(E.wide_predictions(long_predictions(v), ["sample_id", "true_index"], ["a", "b", "c"]))


@query(
    "f18_best_epoch",
    """WITH m AS (SELECT user_id%20 AS run, event_id//20 AS epoch, avg(value)/100.0E0 AS q, min(value)/100.0E0 AS w FROM events GROUP BY ALL),
    f AS (SELECT run, epoch, 0.1E0*(q+w)+0.9E0*(q*0.5E0+w*0.5E0) AS fitness FROM m)
    SELECT run, epoch AS best_epoch, round(fitness,6)+0.0E0 AS fitness FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY fitness DESC, epoch) AS k FROM f) WHERE k=1""",
)
def f18(v):
    log = (
        v.table("events")
        .groupBy((F.col("user_id") % 20).alias("run"), F.floor(F.col("event_id") / 20).alias("epoch"))
        .agg((F.avg("value") / 100.0).alias("box_map50"), (F.min("value") / 100.0).alias("pose_map50"))
        .withColumn("box_map5095", F.col("box_map50") * 0.5)
        .withColumn("pose_map5095", F.col("pose_map50") * 0.5)
    )
    return tidy(E.best_epoch(log))
