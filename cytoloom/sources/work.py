"""Cutting the lineage of iterative plans through the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset and the session is local, as in tests, a temporary folder of
    this machine is made and set; a cluster must name one."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    at = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="cytoloom-")
    if not held.isDefined():
        context.setCheckpointDir(at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back. For plans of many rounds: a checkpoint keeps the constraints of the plan
    that it cuts, and those of joins on joins double from round to round; a table read has none. It is computed once, too,
    where a checkpoint computes twice."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
