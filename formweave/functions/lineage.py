"""Frames that are computed once, and the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which executors share; in local sessions without one, a temporary folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="formweave-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def materialised(frame: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared folder."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)
