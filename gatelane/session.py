"""Session set-up and the few helpers that depend on cluster settings."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime SQL settings the plans rely on; safe to set on any session.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Driver-built dimension rows above this count are joined without a broadcast hint.
BROADCAST_ROWS = 100_000


def build_session(master: str | None = None, app: str = "gatelane", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a session without that setting on a local master gets a temporary
    folder; on a cluster a machine-local folder would be lost with its node.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    current = getattr(spark, "_gatelane_dir", None)
    if current is None:
        current = tempfile.mkdtemp(prefix="gatelane-")
        spark._gatelane_dir = current
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table survives lost executors, and the plan that follows starts
    from a plain scan with real file statistics.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dimension(spark: SparkSession, table: pa.Table) -> DataFrame:
    """Turn driver-built rows (configuration, label maps) into a DataFrame.

    The row count is known here, so the broadcast hint is given only below
    ``BROADCAST_ROWS``; larger tables are left to adaptive execution.
    """
    df = spark.createDataFrame(table)
    return F.broadcast(df) if table.num_rows <= BROADCAST_ROWS else df


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Use all cores when the input has fewer splits than the cluster has slots.

    Inputs of any real size already have more splits than slots and are returned
    unchanged, so no shuffle is added there.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots, *keys)
