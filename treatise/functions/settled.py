"""Cutting a plan where its result is used more than once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's spark.checkpoint.dir.

    Where none is set, a temporary one is made for a session on one machine; on a cluster that is an error, since
    executors would write to folders of their own.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or _made.get(context.applicationId)
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _made[context.applicationId] = tempfile.mkdtemp(prefix="shared")
    return folder


def settle(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint in the shared folder.

    Spark removes the files of a checkpoint that is no longer used if spark.cleaner.referenceTracking.cleanCheckpoints
    is set.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
