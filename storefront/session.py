"""Session and shared-folder helpers.

Operators never create a session; they receive DataFrames. These helpers are
for tests, the bench and command-line use.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "storefront", driver_memory: str | None = None,
                  checkpoint_dir: str | None = None) -> SparkSession:
    """A session configured the way every operator expects it.

    * AQE on, with skew-join splitting and partition coalescing.
    * UTC session zone (D15); batch timestamps stay timestamp_ntz anyway.
    * No web UI.
    * No recording of the Python call site of every Column: it costs more than
      building the plans of most queries here (errors then lack the Python line).
    * ``checkpoint_dir``: the shared folder for ``spark.checkpoint.dir``.
    """
    master = master or os.environ.get("STOREFRONT_MASTER", "local[8]")
    driver_memory = driver_memory or os.environ.get("STOREFRONT_DRIVER_MEMORY", "4g")
    builder = SparkSession.builder
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = (
        builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where that is unset,
    a folder in the session's warehouse, which the cluster shares as well. The
    library never writes intermediate data to a machine-local folder.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = sc.getConf().get("spark.checkpoint.dir", None)
        if not d:
            d = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/storefront/{label}-{uuid.uuid4().hex}"


def scale_conf(input_bytes: int, cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a cluster run over ``input_bytes`` of input on ``cores``
    executor cores: shuffle partitions sized so each holds about
    ``target_partition_bytes`` (AQE coalesces small ones and splits skewed
    ones), scan splits of the same size, and AQE's runtime broadcast
    threshold kept at a fixed size (a side is broadcast only when its
    measured size is below it)."""
    parts = max(cores * 2, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.session.timeZone": "UTC",
    }
