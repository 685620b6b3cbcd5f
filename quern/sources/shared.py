"""The folder that the driver and all executors share, for what a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """Where ``checkpoint()`` writes: the context's folder, else the session's ``spark.checkpoint.dir``.

    Only a local master, whose executors are this process, may do without: it gets a temporary
    folder. On a cluster that would be a folder of one machine, so it is an error there.
    """
    context = spark.sparkContext
    if folder := context.getCheckpointDir():
        return folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quern-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own within the shared one."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
