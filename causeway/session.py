"""Spark session settings the library relies on.

On a cluster the session is created by the platform; we only read its
settings.  ``spark.checkpoint.dir`` names the shared folder used to cut
lineage; a private folder is chosen only when none is configured (local
runs and tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "16g", app: str = "causeway") -> SparkSession:
    """Session for local runs and tests (the cluster builds its own)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in _LOCAL_CONF.items():
        builder = builder.config(k, v)
    builder = (builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder.  A private one is chosen only where none is
    set and Spark runs in this one process; a cluster must name a shared one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="causeway-ckpt-")
    sc.setCheckpointDir(path)
    return path


def broadcast_limit_rows(spark: SparkSession) -> int:
    """Row bound under which a derived (aggregated) table is broadcast."""
    return int(os.environ.get("CAUSEWAY_BROADCAST_ROWS",
                              spark.conf.get("causeway.broadcast.rows", "2000000")))


def broadcast_limit_bytes(spark: SparkSession) -> int:
    """Byte bound under which a derived table is broadcast."""
    return int(spark.conf.get("causeway.broadcast.bytes", str(256 << 20)))
