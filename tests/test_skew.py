"""Ranks, running totals and percentiles with one key holding a third of all rows."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fringeframe.operators.skew import bounded_groups, group_percentiles, group_rank, running_total


@pytest.fixture(scope="module")
def hot(spark):
    """3000 rows: key 0 holds a third, values with heavy ties."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("k"),
        F.pmod(F.xxhash64("id"), F.lit(50)).cast("double").alias("v"),
        "id",
    )
    return df.withColumn("v", F.when(F.col("id") % 4 == 0, 7.0).otherwise(F.col("v")))


@pytest.mark.parametrize("limit", [5, 100, 10**6])
def test_rank_equals_plain_window(hot, limit):
    ours = group_rank(hot, ["k"], [F.col("v"), F.col("id")], F.col("v"), "rn", limit)
    plain = hot.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("v", "id")).cast("bigint"))
    assert ours.exceptAll(plain).isEmpty() and ours.count() == 3000


@pytest.mark.parametrize("how", ["sum", "max"])
def test_running_total_over_everything(hot, how):
    fn = F.sum if how == "sum" else F.max
    w = Window.orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)
    plain = hot.withColumn("t", fn("id").over(w))
    ours = running_total(hot, [], [F.col("v"), F.col("id")], F.col("v"), "t", F.col("id"), 50, how)
    assert ours.exceptAll(plain).isEmpty() and ours.count() == 3000


@pytest.mark.parametrize("limit", [3, 10**6])
def test_percentiles_equal_numpy(hot, limit):
    rows = group_percentiles(hot, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.995}, limit).collect()
    data = hot.toPandas()
    for r in rows:
        want = np.percentile(data[data["k"] == r["k"]]["v"], [5, 50, 99.5])
        assert np.allclose([r["a"], r["b"], r["c"]], want, atol=1e-12)


def test_percentiles_ignore_null_and_allow_no_key(spark):
    df = spark.createDataFrame([(None,), (1.0,), (3.0,)], "v double")
    assert group_percentiles(df, [], "v", {"m": 0.5}).first()["m"] == 2.0
    assert group_percentiles(df.limit(0), [], "v", {"m": 0.5}).count() == 0


def test_bounded_groups_fail_loudly(hot):
    assert bounded_groups(hot, ["k"], 2000, "x").count() == 3000
    with pytest.raises(Exception, match="group larger than"):
        bounded_groups(hot, ["k"], 500, "x").collect()


def test_partition_count_does_not_matter(spark, hot):
    many = hot.repartition(7, "id")
    one = hot.coalesce(1)
    a = group_rank(many, ["k"], [F.col("v"), F.col("id")], F.col("v"), "rn", 20)
    b = group_rank(one, ["k"], [F.col("v"), F.col("id")], F.col("v"), "rn", 20)
    assert a.exceptAll(b).isEmpty()


def test_ranges_of_a_hot_key_are_found_once(hot):
    """An approximate percentile may differ from run to run; ranges and the totals below them must share one."""
    for keys in (["k"], []):
        plan = group_rank(hot, keys, [F.col("v"), F.col("id")], F.col("v"), "rn", 100)._jdf.queryExecution().toString()
        assert "percentile_approx" not in plan
