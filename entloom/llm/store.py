"""The library's shared-folder tables, and batch sizes for long texts."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..store import Store, shared_dir

__all__ = ["Store", "shared_dir", "small_batches"]

#: Rows and bytes of one Arrow batch to a Python worker, unless the session has other values than Spark's own.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m")}


def small_batches(spark: SparkSession) -> None:
    """Long texts make Spark's default Arrow batches large in the JVM and in the workers; this bounds them."""
    for key, (default, ours) in BATCH.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)
