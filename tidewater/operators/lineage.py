"""Cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """Where ``spark.checkpoint.dir`` says, or, in a local session without it, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named.rstrip("/") if named else "file://" + tempfile.mkdtemp(prefix="tidewater-")


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed where ``spark.checkpoint.dir`` says; only a local session may do without that setting."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()
