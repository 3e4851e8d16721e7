"""Materialising an intermediate result in the folder shared by the cluster.

A staged table cuts the lineage: what follows reads files that survive the loss
of any executor, and every reader sees the same rows in the same chunks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

_local_roots: dict[str, str] = {}
_paths: list[str] = []


def staging_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Only a local session without the setting gets a folder of its own; on a
    cluster a machine-local folder would lose data, so that is an error.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="seriesloom-")
    return _local_roots[app]


def staging_path(spark: SparkSession, name: str) -> str:
    path = f"{staging_root(spark)}/seriesloom/{name}-{uuid.uuid4().hex}"
    _paths.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the shared folder and read it back."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> int:
    """Delete what this driver has staged; DataFrames that read it end with it."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    dropped = 0
    while _paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(_paths.pop())
        dropped += bool(path.getFileSystem(hadoop).delete(path, True))
    return dropped
