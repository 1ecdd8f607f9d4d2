"""The business measures: revenue, quantity, distinct orders and average order value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Exact decimal total behind revenue, average and share; dropped before results leave.
TOTAL = "_total"


def measure(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Group and measure in one aggregate.

    The single distinct count makes Spark combine by (keys, order_id) on the map side first,
    so a hot key is spread over all tasks by its order ids.
    """
    return df.groupBy(*keys).agg(
        F.sum("amount").alias(TOTAL),
        F.sum("qty").cast("bigint").alias("qty"),
        F.count_distinct("order_id").alias("order_count"),
    )


def as_revenue(total: str = TOTAL) -> Column:
    return F.round(F.col(total), 2).cast("double")


def half_up(numerator: str, denominator: str) -> str:
    """SQL for the whole number nearest to a ratio, ties away from zero; null over zero."""
    n, d = f"({numerator})", f"nullif({denominator}, 0)"
    return (
        f"cast(signum({n}) as int) * "
        f"((2 * abs({n}) + {d}) div (2 * {d}))"
    )


def cents(total: str) -> str:
    return f"cast({total} * 100 as decimal(38, 0))"


def as_average(total: str = TOTAL, orders: str = "order_count") -> Column:
    """Revenue per order to two decimals, computed in whole cents so no double is rounded."""
    return F.expr(half_up(cents(total), orders)) / F.lit(100)


def as_percent(part: str, whole: str) -> Column:
    """Share of a total in percent to one decimal, computed in whole cents."""
    return F.expr(half_up(f"{cents(part)} * 1000", cents(whole))) / F.lit(10)
