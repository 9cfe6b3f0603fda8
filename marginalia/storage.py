"""Shared storage for intermediate tables.

Every executor must reach the folder, so it is the one the cluster names in
``spark.checkpoint.dir``. Only a local session without that setting gets a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_CONF = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get(_LOCAL_CONF, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="run-")
    spark.conf.set(_LOCAL_CONF, root)
    return root


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared root; nothing is created yet."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def posix_path(path: str) -> str:
    """The plain file path of a ``file:`` URI; executors open it directly."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: this sink needs a mounted file system")
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result survives lost executors, has a one-scan lineage, and carries its true size, so that
    Catalyst broadcasts it only when it really is below the broadcast threshold.
    """
    path = run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
