"""Is the average order value going up or down?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.functions.bounds import MONTH, strict_day
from tallymart.functions.metrics import as_average, as_revenue, measure
from tallymart.operators.facts import daily_sales
from tallymart.schema import MONEY
from tallymart.sources.star import Star

# Fixed value: length of the "recent" period in days.
RECENT_DAYS = 14


def _verdict(first: Column, last: Column) -> Column:
    return (
        F.when(last > first, "up").when(last < first, "down").when(last == first, "flat")
        .otherwise("insufficient")
    )


def _change(first: Column, last: Column) -> Column:
    return F.abs(last.cast(MONEY) - first.cast(MONEY)).cast("double")


def verdict(daily: DataFrame) -> DataFrame:
    """First against last average of the daily rows; fewer than two days decide nothing.

    min_by and max_by find both ends in one aggregate, without sorting the days.
    """
    value, enough = F.col("average_order_value"), F.col("days") >= 2
    ends = daily.where(value.isNotNull()).agg(
        F.min_by("average_order_value", "date").alias("first"),
        F.max_by("average_order_value", "date").alias("last"),
        F.count(F.lit(1)).alias("days"),
    )
    first, last = F.when(enough, F.col("first")), F.when(enough, F.col("last"))
    return ends.select(
        _verdict(first, last).alias("trend"),
        first.alias("first_value"),
        last.alias("last_value"),
        _change(first, last).alias("change"),
        "days",
    )


def aov_verdict(star: Star, start_date=None, end_date=None) -> DataFrame:
    return verdict(daily_sales(star, start_date, end_date))


def aov_recent(star: Star, days: int = RECENT_DAYS) -> DataFrame:
    """The verdict over the last ``days`` days that have data in the table's date range.

    The newest date is a scalar subquery, so the day filter prunes the scan of the fact.
    """
    newest = star.sales.agg(F.max("date")).scalar()
    recent = star.sales.where(F.col("date") > F.date_sub(newest, days))
    if MONTH in star.sales.columns:
        first = F.date_format(F.date_sub(newest, days), "yyyy-MM")
        recent = recent.where(F.col(MONTH) >= first)
    return verdict(daily_sales(Star(recent, star.stores, star.products)))


def aov_compare(
    star: Star, first: tuple[str, str], second: tuple[str, str]
) -> DataFrame:
    """Average order value of one period against another, ends included.

    Rows are labelled with the periods they fall into, which may overlap, so that orders are
    counted distinctly per period in one ordinary grouping.
    """
    labels = []
    for name, (start, end) in (("first", first), ("second", second)):
        low, high = strict_day(start, f"{name} start"), strict_day(end, f"{name} end")
        inside = (F.col("date") >= F.lit(low)) & (F.col("date") <= F.lit(high))
        labels.append((name, inside))
    either = labels[0][1] | labels[1][1]
    periods = F.array_compact(F.array(*[F.when(inside, name) for name, inside in labels]))
    measured = measure(
        star.sales.where(either).withColumn("period", F.explode(periods)), "period"
    ).select("period", as_revenue().alias("revenue"), "order_count", as_average().alias("aov"))

    def of(period: str, column: str) -> Column:
        return F.max(F.when(F.col("period") == period, F.col(column)))

    row = measured.agg(
        *[
            of(period, column).alias(f"{period}_{column}")
            for period in ("first", "second")
            for column in ("revenue", "order_count", "aov")
        ]
    )
    a, b = F.col("first_aov"), F.col("second_aov")
    return row.select("*", _verdict(a, b).alias("trend"), _change(a, b).alias("change"))
