"""Session settings and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

#: What one task takes at most: bytes of a file, and bytes of a shuffle, whose many partitions adaptive execution joins up to that size.
TASK_BOUNDS = {
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
}

def build_session(app: str = "markloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bound_tasks(spark: SparkSession) -> None:
    """Set ``TASK_BOUNDS`` where the session leaves them open, so the memory of a task does not grow with the tables."""
    for key, value in TASK_BOUNDS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    In a local session a folder is chosen where the setting is absent; on a cluster that is an error, as each executor
    would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="markloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def landing_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for one landed table."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
