"""Session settings the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
}


def build_session(app_name: str = "shelfsight", master: str | None = None, **extra: str) -> SparkSession:
    """Session with UTC, adaptive execution and dynamic partition overwrite."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


PARTITION_BYTES = 256 << 20
#: Compressed bytes that one task takes of a shuffle (adaptive execution merges partitions up to that) and of files: several hundred MB as rows.
TAKEN = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB", "spark.sql.files.maxPartitionBytes": "32MB"}
#: Shuffle files go when the execution that wrote them ends. Else they lie on disk until the driver, which has little garbage to collect, collects it.
CLEANED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def fit_shuffles(spark: SparkSession, shuffled_bytes: int) -> int:
    """Raise the number of shuffle partitions so that one holds about 256 MB; never lower it.

    Adaptive execution merges partitions that turn out small, but it starts from this number and
    cannot go beyond it. What a task takes is limited to ``TAKEN``, where the session states no limits of its own;
    likewise the files of a shuffle are ``CLEANED`` with the execution they belong to.
    """
    now = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = -(-shuffled_bytes // PARTITION_BYTES)
    if wanted > now:
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    for name, limit in (TAKEN | CLEANED).items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, limit)
    return max(now, wanted)
