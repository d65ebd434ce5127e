"""Tasks of votes and kernel features stay as small as they are while the input grows."""

import numpy as np

from fringeframe.operators import evaluate as E
from fringeframe.operators import kernels as K


def test_votes_are_dealt_over_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(E, "VOTES_PER_TASK", 10)
    pred = spark.range(300).selectExpr("id % 100 AS sample_id", "cast(id % 2 AS string) AS model", "id % 2 AS true_index", "(id % 100 + id div 200) % 3 AS predicted_index")
    votes = E.majority_vote(pred, ["model", "sample_id"])
    assert votes.rdd.getNumPartitions() >= 30
    assert {(r["sample_id"], r["predicted_index"]) for r in votes.collect()} == {(i, i % 3) for i in range(100)}


def test_kernel_features_are_made_a_few_rows_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(1)
    train = spark.createDataFrame([(i, i % 2, [float(v) for v in rng.normal(size=3)]) for i in range(40)], "sample_id bigint, class_index bigint, features array<double>").coalesce(1)
    whole = {r["sample_id"]: r["features"] for r in K.nystroem_features(train, train, 10)[0].collect()}
    monkeypatch.setattr(K, "ROWS_AT_ONCE", 7)
    cut = {r["sample_id"]: r["features"] for r in K.nystroem_features(train, train, 10)[0].collect()}
    assert cut.keys() == whole.keys() and all(np.allclose(cut[i], whole[i]) for i in whole)
