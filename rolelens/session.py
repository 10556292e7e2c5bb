"""Session helpers: a local session for tests and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench. Cluster sessions come from spark-submit."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rolelens")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; for a local session without it, a temporary one for all its work."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rolelens-"))
    return spark.sparkContext.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable; never overrides a folder that is already set."""
    root = _shared_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for tables a job writes and reads back."""
    return f"{_shared_root(spark).rstrip('/')}/rolelens-{uuid.uuid4().hex}/{name}"
