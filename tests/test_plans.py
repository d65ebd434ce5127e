"""Plan properties: pruned scans, no Python in native queries, no cartesian products."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from fringeframe.plans.all import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
# Native queries whose whole plan must stay in the JVM.
NATIVE = [
    "b3_validate_positions", "b5_repair_positions", "b10_hash_split", "b12_stratified_split", "c4_resample", "c12_snv",
    "c16_align_class", "c17_class_cv", "d2_radial_profile", "d6_robust_stretch", "d12_features", "d16_physics_scores",
    "e1_anova_f", "e2_mutual_info", "e7_two_d_cos", "e8_select_min_gap", "f3_metrics", "f5_paired_table", "f7_holm",
    "g1_preparations", "g6_leave_one_out", "g12_concentration", "h1_filter_detections", "h8_center_agreement", "i8_score_linear",
]


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name != "f7_holm":
        assert "Python" not in text and "InPandas" not in text


def test_scans_are_pruned_and_filtered(spark):
    text = plan(spark, "h1_filter_detections")
    assert "l_linenumber" in text and "PushedFilters: []" in text
    assert "l_comment" not in text and "l_extendedprice" not in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan(spark, "b10_hash_split") or "struct<o_orderkey:bigint>" in plan(
        spark, "b10_hash_split"
    )


def test_rank_limit_is_applied_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "b12_cap_per_class")
    assert "WindowGroupLimit" in plan(spark, "a5_augmented_catalog")


def test_registry():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 130
    assert set(QUERIES) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0 and "concentration" in rows.columns


def test_library_never_uses_local_checkpoints():
    for file in Path(entry.__file__).parent.glob("fringeframe/**/*.py"):
        assert "localCheckpoint" not in file.read_text()
