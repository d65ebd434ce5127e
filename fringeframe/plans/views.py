"""Stand-in views over the driver tables, as DataFrames and as SQL text for the twin queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeframe.operators.skew import group_rank

CLASS_COUNT = 5
IMAGE_WIDTH, IMAGE_HEIGHT = 1024, 768
BANDS = 64
SIDE = 8
CUBE_BANDS = 10
WAVELENGTH_START = 411.0


class Views:
    """Lazy access to the driver tables of one scale folder and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def detections(self) -> DataFrame:
        """(field_id, det_id, x, y, box_conf, kp_conf): one row per detected center."""
        odd = F.lit(0.5) * (F.col("l_orderkey") % 2)
        return (
            self.table("lineitem")
            .groupBy("l_suppkey", "l_orderkey", "l_linenumber")
            .agg(F.min("l_partkey").alias("p"), F.max("l_quantity").alias("q"), F.max("l_tax").alias("t"))
            .select(
                F.col("l_suppkey").alias("field_id"),
                (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("det_id"),
                (((F.col("p") * 37 + F.col("l_orderkey") * 11) % IMAGE_WIDTH).cast("double") + odd).alias("x"),
                (((F.col("p") * 17 + F.col("l_orderkey") * 29) % IMAGE_HEIGHT).cast("double") + odd).alias("y"),
                (F.col("q") * 0.02).alias("box_conf"),
                (1.0 - 5.0 * F.col("t")).alias("kp_conf"),
            )
        )

    def references(self) -> DataFrame:
        """(field_id, ref_id, x, y): labelled centers, two thirds of the detections jittered."""
        return self.detections().filter("det_id % 30 >= 10").select(
            "field_id",
            F.col("det_id").alias("ref_id"),
            (F.col("x") + (F.col("det_id") % 15 - 7)).alias("x"),
            (F.col("y") + (F.col("det_id") * 7 % 15 - 7)).alias("y"),
        )

    def frames(self) -> DataFrame:
        """(scan_id, event_id, ts, position, captured, capture_seconds)."""
        ranked = group_rank(
            self.table("events"),
            ["user_id"],
            [F.col("ts"), F.col("event_id")],
            F.unix_micros(F.col("ts").cast("timestamp")),
        )
        return ranked.select(
            F.col("user_id").alias("scan_id"),
            "event_id",
            "ts",
            (F.lit(-900000) + F.lit(4000) * F.col("rn")).cast("bigint").alias("position"),
            (F.col("event_type") != "error").alias("captured"),
            F.col("value").alias("capture_seconds"),
        )

    def calibration(self) -> DataFrame:
        """(gradient_id, preparation_id, field_id, include_flag, ring_count, reference_conc)."""
        ranked = group_rank(
            self.table("orders"), ["o_custkey"], [F.col("o_orderkey")], F.col("o_orderkey"), "field_id"
        )
        level = F.col("o_custkey") % 6 * 8 + F.col("o_orderkey") % 4
        gradient = F.array(*[F.lit(g) for g in ("C0", "C1", "C3", "C5", "C7", "C8")])
        return ranked.select(
            gradient[(F.col("o_custkey") % 6).cast("int")].alias("gradient_id"),
            F.col("o_custkey").alias("preparation_id"),
            "field_id",
            F.when(F.col("field_id") <= 5, 1).otherwise(0).alias("include_flag"),
            F.when(F.col("o_orderkey") % 20 == 0, None).otherwise(level.cast("double")).alias("ring_count"),
            (7000.0 * level + (F.col("o_orderkey") % 997).cast("double")).alias("reference_conc"),
        )

    def predictions(self) -> DataFrame:
        """(sample_id, cluster_id, true_index, pred_a, pred_b)."""
        key, cust = F.col("o_orderkey"), F.col("o_custkey")
        return self.table("orders").select(
            key.alias("sample_id"),
            (cust % 30).alias("cluster_id"),
            (key % 5).alias("true_index"),
            F.when(cust % 10 < 8, key % 5).otherwise((key + 1) % 5).alias("pred_a"),
            F.when((cust + key) % 10 < 7, key % 5).otherwise((key + 2) % 5).alias("pred_b"),
        )

    def names(self) -> DataFrame:
        """(sequence_id, class_name, folder, ord, n_chars)."""
        return self.table("documents").select(
            F.concat_ws("_", "source", F.col("doc_id").cast("string")).alias("sequence_id"),
            F.col("lang").alias("class_name"),
            F.col("source").alias("folder"),
            F.col("doc_id").alias("ord"),
            "n_chars",
        )

    def _spread(self, df: DataFrame) -> DataFrame:
        """Spread a file with fewer splits than cores over all cores; larger tables pass unshuffled."""
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    def spectra(self) -> DataFrame:
        """(sample_id, class_index, spectrum ARRAY<DOUBLE>): one row per sample."""
        return self._spread(self.table("embeddings")).select(
            F.col("vec_id").alias("sample_id"),
            (F.col("label") % CLASS_COUNT).cast("bigint").alias("class_index"),
            F.col("embedding").cast("array<double>").alias("spectrum"),
        )

    def images(self) -> DataFrame:
        """(cube_id, class_index, band, height, width, pixels ARRAY<DOUBLE> row-major)."""
        cube = F.floor(F.col("sample_id") / CUBE_BANDS).cast("bigint")
        return self.spectra().select(
            cube.alias("cube_id"),
            (cube % CLASS_COUNT).alias("class_index"),
            (F.col("sample_id") % CUBE_BANDS).alias("band"),
            F.lit(SIDE).alias("height"),
            F.lit(SIDE).alias("width"),
            F.transform("spectrum", lambda v: F.greatest(v, F.lit(0.0)) * 100.0).alias("pixels"),
        )


# Views in dependency order; the text runs on the driver's tables.
VIEW_SQL = {
    "v_detections": """SELECT l_suppkey AS field_id, l_orderkey*10+l_linenumber AS det_id,
  CAST((min(l_partkey)*37+l_orderkey*11)%1024 AS DOUBLE)+0.5*(l_orderkey%2) AS x,
  CAST((min(l_partkey)*17+l_orderkey*29)%768 AS DOUBLE)+0.5*(l_orderkey%2) AS y,
  max(l_quantity)*0.02E0 AS box_conf, 1.0E0-5.0E0*max(l_tax) AS kp_conf
FROM lineitem GROUP BY l_suppkey,l_orderkey,l_linenumber""",
    "v_references": """SELECT field_id, det_id AS ref_id, x+CAST(det_id%15-7 AS DOUBLE) AS x,
  y+CAST((det_id*7)%15-7 AS DOUBLE) AS y FROM v_detections WHERE (det_id % 30) >= 10""",
    "v_frames": """SELECT user_id AS scan_id, event_id, ts,
  -900000+4000*CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts,event_id) AS BIGINT) AS position,
  event_type<>'error' AS captured, value AS capture_seconds FROM events""",
    "v_calibration": """SELECT CASE o_custkey%6 WHEN 0 THEN 'C0' WHEN 1 THEN 'C1' WHEN 2 THEN 'C3' WHEN 3 THEN 'C5' WHEN 4 THEN 'C7' ELSE 'C8' END AS gradient_id,
  o_custkey AS preparation_id, field_id, CASE WHEN field_id<=5 THEN 1 ELSE 0 END AS include_flag,
  CASE WHEN o_orderkey%20=0 THEN NULL ELSE CAST((o_custkey%6)*8+o_orderkey%4 AS DOUBLE) END AS ring_count,
  7000.0E0*((o_custkey%6)*8+o_orderkey%4)+CAST(o_orderkey%997 AS DOUBLE) AS reference_conc
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS field_id FROM orders) o""",
    "v_predictions": """SELECT o_orderkey AS sample_id, o_custkey%30 AS cluster_id, o_orderkey%5 AS true_index,
  CASE WHEN o_custkey%10<8 THEN o_orderkey%5 ELSE (o_orderkey+1)%5 END AS pred_a,
  CASE WHEN (o_custkey+o_orderkey)%10<7 THEN o_orderkey%5 ELSE (o_orderkey+2)%5 END AS pred_b FROM orders""",
    "v_names": """SELECT source||'_'||CAST(doc_id AS VARCHAR(20)) AS sequence_id, lang AS class_name, source AS folder, doc_id AS ord, n_chars FROM documents""",
    "v_spectra": """SELECT vec_id AS sample_id, CAST(label%5 AS BIGINT) AS class_index, band, 411.0E0+band AS wavelength_nm, CAST(v AS DOUBLE) AS intensity
FROM (SELECT vec_id,label,unnest(range(len(embedding))) AS band, unnest(embedding) AS v FROM embeddings) e""",
    "v_pixels": """SELECT CAST(floor(sample_id/10) AS BIGINT) AS cube_id, sample_id%10 AS band, CAST(floor(band/8) AS BIGINT) AS y, band%8 AS x,
  greatest(intensity,0.0E0)*100.0E0 AS intensity, CAST(floor(sample_id/10) AS BIGINT)%5 AS class_index FROM v_spectra""",
}


def with_views(sql: str) -> str:
    """Prefix the SQL with the views it names, as common table expressions."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"\bv_[a-z]+\b", text):
            if name in VIEW_SQL and name not in needed:
                add(VIEW_SQL[name])
                needed.append(name)

    add(sql)
    body = sql.strip()
    views = ",\n".join(f"{name} AS ({VIEW_SQL[name]})" for name in needed)
    if not views:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
