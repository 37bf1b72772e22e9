"""Session helpers: a tuned local session for tests/bench and the checkpoint folder.

On a cluster the session is created by the platform; ``ensure_checkpoint_dir``
only reads ``spark.checkpoint.dir`` there and sets a folder of its own only
when nothing is configured (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Arrow batch size for Python-backed detectors: texts can be 100k characters,
# so keep batches modest to bound Python worker memory.
ARROW_BATCH_ROWS = 2048


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "sievekit") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SIEVEKIT_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    # Unset on a local master: tests and local runs only.
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="sievekit-ckpt-"))
    return sc.getCheckpointDir()


def bound_batches(spark: SparkSession, most_bytes: int = 4 << 20) -> None:
    """Limits the bytes of an Arrow batch, which Spark bounds only in rows by default.

    Long texts would otherwise make batches of gigabytes. A limit that the user set stays.
    """
    key, unset = "spark.sql.execution.arrow.maxBytesPerBatch", (1 << 31) - 1
    if int(spark.conf.get(key, str(unset)).rstrip("b")) >= unset:
        spark.conf.set(key, str(most_bytes))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint dir (never a machine-local temp dir on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
