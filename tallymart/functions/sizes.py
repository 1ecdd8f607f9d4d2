"""Broadcast only what has been measured."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 32 * 1024 * 1024
_FIXED_WIDTH = 16  # generous size of one non-text field plus its share of the row header


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a side for broadcast when its measured size is within the bound.

    Catalyst multiplies the sizes of joined inputs, so it never broadcasts a dimension that is
    itself a join. One aggregate over the (small) side settles it. Beyond the bound the frame
    is returned as it is: Spark then shuffles, and AQE splits hot keys.
    """
    return F.broadcast(df) if measured_bytes(df) <= max_bytes else df


def measured_bytes(df: DataFrame) -> int:
    widths = [
        F.coalesce(F.octet_length(F.col(field.name)), F.lit(0)) + F.lit(_FIXED_WIDTH)
        if isinstance(field.dataType, (T.StringType, T.BinaryType))
        else F.lit(_FIXED_WIDTH)
        for field in df.schema
    ]
    row = reduce(lambda a, b: a + b, widths).cast("bigint")
    return df.agg(F.coalesce(F.sum(row), F.lit(0)).alias("bytes")).first()["bytes"]
