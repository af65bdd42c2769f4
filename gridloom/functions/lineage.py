"""Pinning a frame whose rows must be the same in all branches that use it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by the session; on one machine, where it names none, one of our own."""
    context = spark.sparkContext
    folder = context._jsc.sc().getCheckpointDir()
    if folder.isDefined():
        return folder.get()
    named = context.getConf().get("spark.checkpoint.dir", "")
    if not named and context.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or f"/tmp/gridloom-{uuid.uuid4().hex}")
    return context._jsc.sc().getCheckpointDir().get()


def pinned(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the checkpoint folder: range partitions, which are drawn
    from samples, are then the same for every reader, also after an executor is lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
