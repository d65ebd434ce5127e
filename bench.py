"""Wall time of the headline queries: prints one JSON line.

BENCH_SF_DIR names the table folder (default /root/testdata/sf0.1), BENCH_CPUS the local threads.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from fringeframe.plans.all import QUERIES

HEADLINE = [
    "flagship_calibrated_concentration",
    "b4_position_gaps",
    "b10_hash_split",
    "b12_stratified_split",
    "c4_resample",
    "c9_nonzero_mean",
    "c12_snv",
    "c16_align_class",
    "c17_class_cv",
    "d2_radial_profile_normalised",
    "d12_features",
    "d16_physics_scores",
    "e1_anova_f",
    "e4_pls_vip",
    "e6_relieff",
    "f3_metrics",
    "f5_paired_table",
    "f8_paired_bootstrap",
    "f10_cluster_bootstrap",
    "g1_preparations",
    "g5_ols",
    "g7_stratified_bootstrap",
    "g12_concentration",
    "h1_filter_detections",
    "h2_suppress_centers",
    "h5_match_greedy",
    "h6_match_hungarian",
    "h10_pooled_metrics",
    "i5_knn_classify",
    "i8_score_linear",
    "j2_scan_progress",
]


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fringeframe-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = os.environ.get("BENCH_ONLY", "").split()
    spark = session()
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    times = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
