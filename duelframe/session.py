"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: ANSI arithmetic (explicit safe forms are
# used where the reference divides by zero), UTC day arithmetic, AQE for
# partition coalescing and skew splits at run time.
BASE_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


LOCAL_DRIVER_MEMORY = "8g"


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "duelframe") -> SparkSession:
    """Build (or reuse) a session. ``master`` is only applied when given,
    so on a cluster the launcher's master wins."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode runs every task inside the driver JVM
            builder = builder.config("spark.driver.memory", LOCAL_DRIVER_MEMORY)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Target bytes per shuffle partition and per scan split on a cluster.
SHUFFLE_TARGET_BYTES = 256 * 1024 * 1024
SCAN_SPLIT_BYTES = 512 * 1024 * 1024


def scale_conf(shuffle_bytes: int, executor_cores: int | None = None) -> dict[str, str]:
    """Shuffle and scan sizing for a job whose largest shuffle moves about
    ``shuffle_bytes``: enough initial partitions that each holds ~256 MB
    (so sorts and hash aggregations stay in memory rather than spill), at
    least two waves of the available cores, and AQE left on to coalesce
    the small ones and split skewed ones at run time. 100 TB of shuffle
    gives ~400k initial partitions, coalesced by AQE as stages finish."""
    parts = max(1, -(-shuffle_bytes // SHUFFLE_TARGET_BYTES))
    if executor_cores:
        parts = max(parts, 2 * executor_cores)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(SHUFFLE_TARGET_BYTES // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(SHUFFLE_TARGET_BYTES * 2),
        "spark.sql.files.maxPartitionBytes": str(SCAN_SPLIT_BYTES),
    }


def apply_scale(spark: SparkSession, shuffle_bytes: int, executor_cores: int | None = None) -> dict:
    """Apply ``scale_conf``, except for keys the operator set explicitly at
    launch (those win). Returns what was set."""
    launch = spark.sparkContext.getConf()
    done = {}
    for k, v in scale_conf(shuffle_bytes, executor_cores).items():
        if not launch.contains(k):
            spark.conf.set(k, v)
            done[k] = v
    return done


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    A folder is only invented when the setting is absent *and* the session
    runs in local mode (tests, the bench); on a cluster a machine-local
    folder would not survive the loss of an executor, so the setting is
    required there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local = tempfile.mkdtemp(prefix="duelframe-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()
