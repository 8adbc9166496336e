"""Session settings and the shared work folder.

Iterative operators cut their lineage through tables written below the folder
the cluster names in ``spark.checkpoint.dir``: every executor can reach it and
it outlives the loss of any one of them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SHARED_DIR_CONF = "spark.checkpoint.dir"


def build_session(app_name: str = "topicloom", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; made up only in local mode, if none is set."""
    configured = spark.conf.get(SHARED_DIR_CONF, None)
    if configured:
        return configured.rstrip("/")
    context_dir = spark.sparkContext.getCheckpointDir()
    if context_dir:
        return context_dir.rstrip("/")
    if not is_local(spark.sparkContext.master):
        raise ValueError(f"set {SHARED_DIR_CONF} to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="topicloom-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def is_local(master: str) -> bool:
    """Whether driver and tasks are one process and so share its disk."""
    return master == "local" or master.startswith("local[")


def work_path(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for one job's intermediate tables."""
    return f"{shared_dir(spark)}/topicloom/{purpose}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a work folder once its results are stored elsewhere."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below ``path``; metadata only, no data is read."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop_path):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(hadoop_path))
