"""Session settings and small helpers on how work is spread."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quadrille", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; on a cluster the master and resources come from spark-submit."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where it is unset, as in local tests."""
    sc = spark.sparkContext
    set_already = sc.getCheckpointDir()
    if set_already:
        return set_already
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quadrille-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """More partitions for costly per-row work, only where the scan has fewer than ``per_core`` for each core.

    A scan of a large table has enough splits already and is left as it is, so nothing is moved at scale.
    """
    want = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of its own below the shared one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written once, by columns, to the shared folder and read back: what many queries use is computed once, and its lineage is cut."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
