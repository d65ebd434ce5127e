import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeframe.operators import detect as H


def centers(spark, n=300, seed=0, side=200.0):
    rng = np.random.default_rng(seed)
    rows = [(int(i % 3), int(i), float(np.round(x)), float(np.round(y)), float(s)) for i, (x, y, s) in enumerate(zip(rng.random(n) * side, rng.random(n) * side, rng.random(n)))]
    return spark.createDataFrame(rows, "field_id bigint, det_id bigint, x double, y double, joint double")


def naive_suppress(rows, d):
    kept = []
    for r in sorted(rows, key=lambda r: (-r["joint"], r["det_id"])):
        if all((r["x"] - k["x"]) ** 2 + (r["y"] - k["y"]) ** 2 >= d * d for k in kept):
            kept.append(r)
    return {r["det_id"] for r in kept}


@pytest.mark.parametrize("limit", [10, 10**6])
def test_suppression_both_ways(spark, limit):
    df = centers(spark)
    got = H.suppress_centers(df, 15.0, field_limit=limit)
    for f in range(3):
        rows = df.filter(F.col("field_id") == f).collect()
        assert {r["det_id"] for r in got.filter(F.col("field_id") == f).collect()} == naive_suppress(rows, 15.0)


def test_suppression_of_many_copies(spark):
    """A third of all rows at one spot: one survives, in both ways."""
    df = centers(spark, 60).withColumn("x", F.when(F.col("det_id") % 3 == 0, 50.0).otherwise(F.col("x"))).withColumn(
        "y", F.when(F.col("det_id") % 3 == 0, 50.0).otherwise(F.col("y"))
    ).withColumn("field_id", F.lit(1).cast("bigint"))
    a = {r["det_id"] for r in H.suppress_centers(df, 10.0, field_limit=5).collect()}
    assert a == naive_suppress(df.collect(), 10.0)


@pytest.mark.parametrize("limit", [10, 10**6])
def test_box_suppression_both_ways(spark, limit):
    df = centers(spark, 120, 4).select(
        "field_id", "det_id", F.col("x").alias("bx"), F.col("y").alias("by"), (20.0 + F.col("det_id") % 7 * 5).alias("bw"),
        (20.0 + F.col("det_id") % 5 * 6).alias("bh"), F.col("joint").alias("score"),
    )
    got = {(r["field_id"], r["det_id"]) for r in H.nms_boxes(df, 0.2, field_limit=limit).collect()}
    want = set()
    for f in range(3):
        kept = []
        for r in sorted(df.filter(F.col("field_id") == f).collect(), key=lambda r: (-r["score"], r["det_id"])):
            def iou(k):
                side = lambda c, s: max(0.0, min(r[c] + r[s] / 2, k[c] + k[s] / 2) - max(r[c] - r[s] / 2, k[c] - k[s] / 2))
                shared = side("bx", "bw") * side("by", "bh")
                return shared / (r["bw"] * r["bh"] + k["bw"] * k["bh"] - shared)
            if all(iou(k) <= 0.2 for k in kept):
                kept.append(r)
        want |= {(f, r["det_id"]) for r in kept}
    assert got == want


def test_verdict_order_and_rounding(spark):
    df = spark.createDataFrame(
        [(1, 1, 100.5, 101.5, 0.9, None), (1, 2, 1.0, 1.0, 0.1, 0.9), (1, 3, 1.0, 100.0, 0.9, 0.9), (1, 4, float("nan"), 100.0, 0.9, 0.9)],
        "field_id bigint, det_id bigint, x double, y double, box_conf double, kp_conf double",
    )
    judged = H.judge_detections(df, 0.5, 20, 200, 200)
    assert [r["verdict"] for r in judged.orderBy("det_id").collect()] == ["accepted", "confidence", "edge", "confidence"]
    row = H.accepted(judged).first()
    assert (row["x"], row["y"], row["joint"]) == (100.0, 102.0, 0.9)


@pytest.mark.parametrize("shape", [(3, 4), (4, 3), (5, 5), (0, 3), (1, 6)])
def test_assignment_against_permutations(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(20):
        cost = np.round(rng.random(shape) * 10, 1)
        i, j = H.assign(cost)
        small, large = min(shape), max(shape)
        best = min(
            (sum((cost[a, b] if shape[0] <= shape[1] else cost[b, a]) for a, b in enumerate(p)) for p in itertools.permutations(range(large), small)),
            default=0.0,
        )
        assert len(i) == small and cost[i, j].sum() == pytest.approx(best)


def points(spark, rows, key):
    return spark.createDataFrame([(1, *r) for r in rows], f"field_id bigint, {key} bigint, x double, y double")


def test_three_matching_rules_differ(spark):
    # References at 0 and 10, detections at 9 and 19 on a line.
    refs = points(spark, [(0, 0.0, 0.0), (1, 10.0, 0.0)], "ref_id")
    dets = points(spark, [(0, 9.0, 0.0), (1, 19.0, 0.0)], "det_id")
    pick = lambda df: sorted((r["ref_id"], r["det_id"]) for r in df.collect())
    assert pick(H.match_greedy(refs, dets, 9.5)) == [(1, 0)]
    assert pick(H.match_hungarian(refs, dets)) == [(0, 0), (1, 1)]
    assert pick(H.match_penalised(refs, dets, 9.5)) == [(0, 0), (1, 1)]


def total_cost(pairs, n, m, r):
    return sum(p for p in pairs) + (r + 1) * (n + m - 2 * len(pairs))


def test_penalised_matching_is_optimal(spark):
    rng = np.random.default_rng(9)
    refs = points(spark, [(i, *map(float, rng.random(2) * 30)) for i in range(6)], "ref_id")
    dets = points(spark, [(i, *map(float, rng.random(2) * 30)) for i in range(5)], "det_id")
    got = H.match_penalised(refs, dets, 10.0).collect()
    a, b = refs.orderBy("ref_id").toPandas(), dets.orderBy("det_id").toPandas()
    d = np.hypot(a.x.values[:, None] - b.x.values, a.y.values[:, None] - b.y.values)
    best = np.inf
    for k in range(6):
        for left in itertools.combinations(range(6), k):
            for right in itertools.permutations(range(5), k):
                used = [d[i, j] for i, j in zip(left, right)]
                if all(u <= 10.0 for u in used):
                    best = min(best, total_cost(used, 6, 5, 10.0))
    assert total_cost([r["distance"] for r in got], 6, 5, 10.0) == pytest.approx(best)


def test_greedy_matching_rounds_equal_kernel(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, np.round(rng.random(2) * 60))) for i in range(60)]
    refs = points(spark, rows, "ref_id")
    dets = points(spark, [(i, x + float(rng.integers(-4, 5)), y) for i, x, y in rows], "det_id")
    a = H.match_greedy(refs, dets, 12.0, field_limit=1).select("ref_id", "det_id")
    b = H.match_greedy(refs, dets, 12.0).select("ref_id", "det_id")
    assert a.exceptAll(b).isEmpty() and a.count() == b.count()


def test_empty_sides(spark):
    refs = points(spark, [(0, 1.0, 1.0)], "ref_id")
    none = points(spark, [], "det_id")
    for match in (H.match_greedy(refs, none, 5.0), H.match_hungarian(refs, none), H.match_penalised(refs, none, 5.0)):
        assert match.isEmpty()
    row = H.field_metrics(H.match_greedy(refs, none, 5.0), refs, none).first()
    assert (row["tp_5px"], row["precision_5px"], row["f1_5px"], row["count_error"]) == (0, 0.0, 0.0, -1)


def test_letterbox():
    assert H.letterbox(1024, 768, 640) == (0.625, 0, 80)


def test_many_copies_of_a_detection(spark):
    """A third of the detections at one spot: same matches, few candidate pairs."""
    rng = np.random.default_rng(6)
    refs = points(spark, [(i, *map(float, np.round(rng.random(2) * 40))) for i in range(12)], "ref_id")
    rows = [(i, 20.0, 20.0) if i % 3 == 0 else (i, *map(float, np.round(rng.random(2) * 400))) for i in range(600)]
    dets = points(spark, rows, "det_id")
    every = H.candidate_pairs(refs, dets, 15.0)
    few = H.reduced_pairs(refs, dets, 15.0, ["field_id"])
    assert few.count() <= 12 * 12 + 60 < every.count()
    want = every.groupBy("field_id").applyInPandas(H._greedy_pairs, every.schema)
    got = H.match_greedy(refs, dets, 15.0)
    assert got.exceptAll(want).isEmpty() and got.count() == want.count() > 0
    pairs = every.toPandas()
    saving = np.zeros((12, 600 + 12))
    saving[pairs.ref_id, pairs.det_id] = 32.0 - pairs.distance
    best = saving[H.assign(-saving)].sum()
    assert H.match_penalised(refs, dets, 15.0).selectExpr("sum(32.0 - distance)").first()[0] == pytest.approx(best)


def test_penalised_matching_of_a_large_field_and_a_long_chain(spark):
    n = 4_001
    refs = spark.range(n).selectExpr("1 as field_id", "id as ref_id", "id * 10.0 as x", "0.0 as y")
    dets = spark.range(n).selectExpr("1 as field_id", "id as det_id", "id * 10.0 + 1 as x", "0.0 as y")
    got = H.match_penalised(refs, dets, 3.0)
    assert got.count() == n and got.filter("ref_id <> det_id").isEmpty()
    chain = H.match_penalised(refs, dets, 9.5).agg({"distance": "sum", "ref_id": "count"}).first()
    assert sorted(chain) == [n, float(n)]


def test_greedy_fields_list_no_pairs_by_a_join(spark, monkeypatch):
    rng = np.random.default_rng(8)
    some = lambda n: [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 60, (n, 2)) / 2)]
    refs, dets = points(spark, some(80) + [(90, float("nan"), 1.0)], "ref_id"), points(spark, some(120), "det_id")
    every = H.candidate_pairs(refs, dets, 4.0)
    want = every.groupBy("field_id").applyInPandas(H._greedy_pairs, every.schema).collect()

    def never(*_args, **_kwargs):
        raise AssertionError("a small field needs no join of pairs")

    monkeypatch.setattr(H, "candidate_pairs", never)
    got = H.match_greedy(refs, dets, 4.0).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 40
