"""Session settings the jobs rely on."""
from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even if a later operator then needs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Stored columns that repeat or count up shrink to a few bytes a row, so file sizes tell too little of
    # the rows in memory; without a factor the planner broadcasts (through the driver) millions of keys.
    "spark.sql.sources.fileCompressionFactor": "10",
    # Arrow batches for Python end at so many bytes or 10 000 rows; by rows alone, long texts make them large.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4MB",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings (no cluster sizing: that belongs to the deployment)."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point reliable checkpoints at the shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster a
    machine-local folder would lose data with its executor, so that case is refused.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="vocalake-checkpoint-")
    context.setCheckpointDir(shared)
