"""Settings that the plans rely on."""

from __future__ import annotations

from tallymart import session

ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def test_tasks_read_bounded_partitions_and_smaller_ones_stay(spark):
    before = spark.conf.get(ADVISORY)
    try:
        for given, kept in (("64MB", session.TASK_BYTES), ("1g", session.TASK_BYTES), ("1m", 1 << 20), ("65536b", 1 << 16)):
            spark.conf.set(ADVISORY, given)
            session.tune(spark)
            assert session._bytes(spark.conf.get(ADVISORY)) == kept
    finally:
        spark.conf.set(ADVISORY, before)
