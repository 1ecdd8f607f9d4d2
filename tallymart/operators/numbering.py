"""Dense row numbers without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymart.session import ensure_checkpoint_dir

_WITHIN = (1 << 33) - 1  # row part of monotonically_increasing_id


def number_rows(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Add ``name`` = 1..n in the given order, ties in any order.

    Rows are range-partitioned over the order columns plus a tie-breaker, so that even a long
    run of equal rows is spread, then sorted and checkpointed: the partition a row lies in must
    not change between counting and numbering, also when an executor is lost. Each partition
    numbers its own rows and adds the sizes of the partitions before it. The offsets have one
    row per partition, whatever the data size.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ordered = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*order, "_tie")
        .sortWithinPartitions(*order, "_tie")
        .drop("_tie")
        .checkpoint()
    )
    placed = ordered.select(
        "*",
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(_WITHIN).alias("_at"),
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return placed.join(F.broadcast(offsets), "_part").select(
        (F.col("_at") + F.col("_offset") + 1).cast("bigint").alias(name), *df.columns
    )
