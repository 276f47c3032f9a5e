"""Session helpers.

``get_session`` is for local runs and tests.  On a cluster the caller owns the
session; the library only reads ``spark.checkpoint.dir`` from it and never
picks a machine-local folder unless the setting is absent (local/test use).

Sizing on a cluster: keep ``spark.sql.shuffle.partitions`` high (a few times
the core count) and let AQE coalesce small partitions towards
``spark.sql.adaptive.advisoryPartitionSizeInBytes``; AQE also splits skewed
join partitions.  Scans split input at ``spark.sql.files.maxPartitionBytes``
(128 MB).  Locally the shuffle partitions equal the core count.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session of this library should carry.  AQE re-plans joins
# and coalesces / splits shuffle partitions at run time (skew included).
SESSION_DEFAULTS: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "flipwise") -> SparkSession:
    """Build (or reuse) a local session with the library defaults."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(os.environ.get("FLIPWISE_SHUFFLE_PARTITIONS", cpus))
    b = SparkSession.builder.master(master).appName(app_name)
    for k, v in SESSION_DEFAULTS.items():
        b = b.config(k, v)
    b = (b.config("spark.sql.shuffle.partitions", str(parts))
          .config("spark.driver.memory", os.environ.get("FLIPWISE_DRIVER_MEMORY", "16g")))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    Uses ``spark.checkpoint.dir`` when the cluster names one (shared storage).
    Only a local master may leave it unset: a fresh scratch folder is made
    then.  On a cluster a machine-local folder would leave each executor with
    its own part of every stored table, so an unset folder is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="flipwise-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
