"""Session defaults and lineage cutting."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the plans rely on. Joins carry no broadcast hints: the threshold below
# is the size check, and adaptive execution falls back to a sort-merge join with
# skewed partitions split when a side turns out larger.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Recording a call site for every column costs more than building these plans.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(builder: SparkSession.Builder, **extra: str) -> SparkSession.Builder:
    """Apply the library defaults (then ``extra``) to a session builder."""
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for materialised tables: the cluster's checkpoint directory.

    A machine-local folder is used only when the session runs in local mode and
    names none; on a cluster a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _local_dir()


@functools.cache
def _local_dir() -> str:
    # The setting itself is fixed once a session runs.
    return tempfile.mkdtemp(prefix="spark-")


def scratch_path(spark: SparkSession) -> str:
    """A fresh folder name under the shared folder."""
    return f"{scratch_dir(spark).rstrip('/')}/panelworks/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Used where one intermediate feeds several branches: the branches then scan a
    columnar table instead of recomputing its lineage, and a lost executor costs
    only the tasks that ran on it.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
