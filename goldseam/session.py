"""Session settings and the shared folder that jobs stage data in."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: strict casts must fail (ANSI), day and time
# values must not depend on the machine (UTC), and AQE must be free to merge
# small shuffle partitions, split skewed ones and pick broadcast by real size.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# On a cluster shuffles begin with many partitions and AQE merges them up to the advisory size.
CLUSTER = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
}


def build_session(app_name: str = "goldseam", master: str | None = None, **extra: str) -> SparkSession:
    """Start (or get) a session; keys in ``extra`` override the defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    cluster = {} if (master or "").startswith("local") else CLUSTER
    for key, value in {**SETTINGS, **cluster, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _configured_dir(spark: SparkSession) -> str | None:
    # Both are static settings: the cluster sets them, a job only reads them.
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors reach, from ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster an
    unset folder is an error, since executors would each write to their own disk.
    """
    configured = _configured_dir(spark)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="goldseam-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for one run below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
