"""Session settings the analytics rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Only settings that matter for correctness or for skewed keys; sizing (executors,
# memory, shuffle partitions) belongs to the cluster that runs the job.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Sizes known while planning are estimates, far too low after an explode: trust them for
    # tiny tables only. Sizes measured between stages may decide on larger broadcasts.
    "spark.sql.autoBroadcastJoinThreshold": "512KB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    # Rows that are dealt by a key stay where they are when they are joined by that key and a day.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Few rows looked up in a long timeline: let a filter on their keys reach its scan.
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "256MB",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply ``SETTINGS`` to a running session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
