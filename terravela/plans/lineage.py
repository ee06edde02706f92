"""Cutting lineage in the shared checkpoint folder, and broadcasts behind a check of their size."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a temporary one on a local master, as in tests; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder; nothing is created there yet."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a table written in the shared folder and read back.

    As cut, but the planner knows nothing of what it held: in long loops the constraints that a checkpoint
    carries multiply with each round's expressions until planning takes longer than the work.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, "stored")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_below(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only if df has at most max_rows rows; beyond that the planner shuffles.

    df should be cheap to count (checkpointed or a small scan). The caller picks max_rows
    so that max_rows times the row width is a bound in bytes that every executor can hold.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
