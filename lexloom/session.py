"""What the operators need of a session."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names. Only where it names none and runs in one process, as in tests, a temporary one is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="lexloom-checkpoints-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows in the folder that the cluster shares: cuts the plan, and a lost executor costs no more than a read."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def released(df: DataFrame) -> DataFrame:
    """The rows, checkpointed, once the driver has collected its garbage.

    Spark removes a finished job's shuffle files, broadcasts and checkpoints when the driver collects the objects that
    stand for them, and a heap that has grown over one plan stays grown for the next. Where plans follow each other,
    the garbage of each is collected here. What the caller or Spark still refers to stays.
    """
    out = checkpointed(df)
    out.sparkSession._jvm.System.gc()
    return out
