"""Session settings and the shared folders that jobs may write to."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the plans rely on. forceOptimizeSkewedJoin lets AQE split a hot join key
# even where the split costs one more shuffle downstream; it acts only when skew is found.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# Shuffled bytes that one task reads at most where AQE merges partitions. Sorted and hashed rows take some twenty
# times as much memory, so a task's memory follows this and not the table.
TASK_BYTES = 8 << 20
_ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; partition counts stay the cluster's choice, and sizes where they are smaller."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    if _bytes(spark.conf.get(_ADVISORY)) > TASK_BYTES:
        spark.conf.set(_ADVISORY, str(TASK_BYTES))
    return spark


def _bytes(size: str) -> int:
    """A size as Spark writes it, such as 64MB, 8m or 67108864b."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]*)\s*", size).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit[:1].lower()]


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only where the setting is absent (a local test session) is a temporary folder used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    return _local_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable without overriding the cluster's folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named:
            spark.sparkContext.setCheckpointDir(named)
        else:
            _local_checkpoint_dir(spark)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; nothing is ever overwritten or removed."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a step to the shared folder and read it back: it is computed once and its lineage ends there."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _local_checkpoint_dir(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="tallymart-")
    spark.sparkContext.setCheckpointDir(path)
    return path
