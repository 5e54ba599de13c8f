"""Session helpers for tests, the bench and local runs.

Library code never creates a session; it uses the one that built its
DataFrames.  These settings are the local defaults: AQE on (runtime
coalescing, skew-join splitting, join re-planning), UI off, UTC.
"""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tablewright") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", os.environ.get("TW_SESSION_TZ", "UTC"))
        .config("spark.driver.memory", os.environ.get("TW_DRIVER_MEMORY") or _driver_memory())
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.warehouse.dir", os.environ.get("TW_WAREHOUSE_DIR") or tempfile.mkdtemp(prefix="tw-warehouse-"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _driver_memory() -> str:
    """Half the machine's memory, capped at 8 GiB (local mode runs
    everything inside the driver JVM)."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "4g"
    return f"{max(1, min(8, total // 2 // (1 << 30)))}g"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use ``spark.checkpoint.dir`` when the cluster names it.  Only a local
    session (tests, local runs) without one gets a fresh local folder; on a
    cluster a missing setting is an error, never a machine-local folder."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to shared storage: staging and merges write there")
        d = tempfile.mkdtemp(prefix="tw-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scale_conf(input_bytes: int, total_cores: int, *, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings sized for a large cluster run (apply with ``SparkSession.builder.config``).

    Shuffle partitions: enough that one reducer's share stays near
    ``target_partition_bytes`` (AQE coalesces small ones and splits skewed
    ones at run time), and never fewer than twice the cores.  Scan splits of
    256 MiB keep map tasks long enough to amortise start-up.
    """
    parts = max(2 * total_cores, -(-int(input_bytes) // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes * 2),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        # broadcast only what Spark measured to be small
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
    }
