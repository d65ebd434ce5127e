"""Materialising intermediates in the shared folder of the cluster."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder the session names; a temporary one only where none is set, as in local tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = configured or spark.sparkContext.getCheckpointDir()
    if not current:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, survives executor loss, lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


# Rows of a task where a step holds or sorts them.
TASK_ROWS = 250_000


def dealt(df: DataFrame, keys: list[str], rows: int, per_task: int = TASK_ROWS) -> DataFrame:
    """Dealt by hash of the keys over tasks whose number grows with the rows, so that a task's share does not."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(max(usual, -(-rows // per_task)), *keys)
