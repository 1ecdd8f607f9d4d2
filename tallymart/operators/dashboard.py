"""Dashboard aggregates: strict date bounds, dirty cells tolerated, zeros instead of nulls.

Unlike the fact queries these keep sales whose store or product is unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymart.functions import values
from tallymart.functions.bounds import between_strict, dashboard_limit, first_rows
from tallymart.functions.metrics import TOTAL, as_average, as_percent, as_revenue, measure
from tallymart.operators.facts import dataset_summary
from tallymart.sources.star import Star

# What is shown where a name or category is missing.
UNKNOWN = "Unknown"
NO_CATEGORY = "-"
NO_CATEGORY_LEGEND = "未知分类"


def readable(sales: DataFrame) -> DataFrame:
    """Parse date and amount where the table still holds them as text; typed cells pass."""
    parsed = {}
    if isinstance(sales.schema["date"].dataType, T.StringType):
        parsed["date"] = values.parse_date_year_first(F.col("date"))
    if isinstance(sales.schema["amount"].dataType, T.StringType):
        parsed["amount"] = values.money(F.col("amount"))
    if not parsed:
        return sales
    others = [F.col(c) for c in sales.columns if c not in parsed]
    return values.computed_once(sales, parsed, others)


def _filled(df: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return df.withColumn(TOTAL, F.coalesce(TOTAL, zero.cast("decimal(28, 2)"))).withColumn(
        "qty", F.coalesce("qty", zero.cast("bigint"))
    )


def _measured(sales: DataFrame, key: str) -> DataFrame:
    """Measures per key without the null group; all-null sums count as zero."""
    return _filled(measure(sales.where(F.col(key).isNotNull()), key))


def _largest_first(key: str) -> list[Column]:
    return [F.desc(TOTAL), F.asc(key)]


def meta(star: Star) -> DataFrame:
    """Row counts and the range of readable dates."""
    return dataset_summary(Star(readable(star.sales), star.stores, star.products))


def daily_sales(star: Star, start_date=None, end_date=None) -> DataFrame:
    """Revenue, orders and average order value per day."""
    sales = between_strict(readable(star.sales), start_date, end_date)
    return (
        _measured(sales, "date")
        .select(
            "date",
            as_revenue().alias("revenue"),
            "order_count",
            F.coalesce(as_average(), F.lit(0.0)).alias("average_order_value"),
        )
        .orderBy("date")
    )


def _top(star: Star, start_date, end_date, limit) -> DataFrame:
    wanted = dashboard_limit(limit)
    sales = between_strict(readable(star.sales), start_date, end_date)
    return first_rows(
        _measured(sales, "product_id").orderBy(*_largest_first("product_id")), wanted
    )


def top_products(star: Star, start_date=None, end_date=None, limit=10) -> DataFrame:
    """The products with most revenue; the name joins only the rows that are left.

    ``limit`` is 1 to 100, or None for every product; anything else raises.
    """
    named = star.products.select("product_id", "product_name", "product_category")
    return (
        _top(star, start_date, end_date, limit)
        .join(named, "product_id", "left")
        .orderBy(*_largest_first("product_id"))
        .select(
            "product_id",
            as_revenue().alias("revenue"),
            "qty",
            "order_count",
            "product_name",
            "product_category",
        )
    )


def store_sales(star: Star, start_date=None, end_date=None) -> DataFrame:
    """Measures per store, largest revenue first."""
    sales = between_strict(readable(star.sales), start_date, end_date)
    return (
        _measured(sales, "store_id")
        .join(star.stores, "store_id", "left")
        .orderBy(*_largest_first("store_id"))
        .select(
            "store_id",
            as_revenue().alias("revenue"),
            "order_count",
            "qty",
            "store_name",
            "category",
            "district",
            F.coalesce(as_average(), F.lit(0.0)).alias("average_order_value"),
        )
    )


def _per_category(star: Star, start_date, end_date) -> DataFrame:
    sales = between_strict(readable(star.sales), start_date, end_date)
    categories = star.products.select("product_id", "product_category")
    return _filled(measure(sales.join(categories, "product_id", "left"), "product_category"))


def category_sales(star: Star, start_date=None, end_date=None) -> DataFrame:
    """Measures per category, largest revenue first; sales without one are ``Unknown``."""
    return (
        _per_category(star, start_date, end_date)
        .orderBy(F.desc(TOTAL), F.asc_nulls_last("product_category"))
        .select(
            F.coalesce("product_category", F.lit(UNKNOWN)).alias("product_category"),
            as_revenue().alias("revenue"),
            "qty",
            "order_count",
        )
    )


def kpi_summary(star: Star, start_date=None, end_date=None) -> DataFrame:
    """Totals over the daily rows.

    ``order_count`` adds up the days, so an order spanning two days counts twice, as the cards
    on the dashboard do; ``distinct_orders`` counts it once. Days and orders come out of one
    aggregate: one row per order and day, then per order, then one row.
    """
    sales = between_strict(readable(star.sales), start_date, end_date)
    per_order = (
        sales.where(F.col("date").isNotNull())
        .groupBy("order_id")
        .agg(F.sum("amount").alias(TOTAL), F.count_distinct("date").alias("days"))
    )
    known = F.col("order_id").isNotNull()
    return per_order.agg(
        F.coalesce(F.sum(TOTAL), F.lit(0).cast("decimal(38, 2)")).alias(TOTAL),
        F.coalesce(F.sum(F.when(known, F.col("days"))), F.lit(0)).cast("bigint").alias("order_count"),
        F.count_if(known).alias("distinct_orders"),
    ).select(
        as_revenue().alias("revenue"),
        "order_count",
        F.coalesce(as_average(), F.lit(0.0)).alias("average_order_value"),
        "distinct_orders",
    )


def category_share(star: Star, start_date=None, end_date=None) -> DataFrame:
    """Each category's part of all revenue, in percent."""
    per_category = _per_category(star, start_date, end_date)
    whole = per_category.agg(F.sum(TOTAL)).scalar()
    return (
        per_category.withColumn("_whole", whole)
        .orderBy(F.desc(TOTAL), F.asc_nulls_last("product_category"))
        .select(
            F.coalesce("product_category", F.lit(UNKNOWN)).alias("product_category"),
            as_revenue().alias("revenue"),
            F.coalesce(as_percent(TOTAL, "_whole"), F.lit(0.0)).alias("share_percent"),
        )
    )


def ranked_products(star: Star, start_date=None, end_date=None, limit=10) -> DataFrame:
    """top_products with its position; the window sees at most ``limit`` rows, so it needs one."""
    if limit is None:
        raise ValueError("Invalid limit: positions need a limit")
    position = F.row_number().over(Window.orderBy(*_largest_first("product_id")))
    top = _top(star, start_date, end_date, limit).withColumn("position", position.cast("bigint"))
    named = star.products.select("product_id", "product_name", "product_category")
    return (
        top.join(named, "product_id", "left")
        .orderBy("position")
        .select(
            "position",
            "product_id",
            "product_name",
            "product_category",
            as_revenue().alias("revenue"),
        )
    )


def product_sales(star: Star, start_date=None, end_date=None) -> DataFrame:
    """Revenue of every product sold, known or not."""
    sales = between_strict(readable(star.sales), start_date, end_date)
    named = star.products.select("product_id", "product_name", "product_category")
    return (
        _measured(sales, "product_id")
        .join(named, "product_id", "left")
        .select("product_id", "product_name", "product_category", as_revenue().alias("revenue"))
    )


def format_money(amount: Column) -> Column:
    """``¥`` with grouped thousands and two decimals; null shows as zero."""
    return F.concat(
        F.lit("¥"), F.format_number(F.coalesce(amount, F.lit(0)).cast("decimal(28, 2)"), 2)
    )


def _or_else(col: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(col, F.lit("")), fallback)


def labelled(products: DataFrame) -> DataFrame:
    """Texts the dashboard shows for product rows: table cells, legend entry and money."""
    return products.select(
        "product_id",
        _or_else(F.col("product_name"), F.col("product_id").cast("string")).alias("product_label"),
        _or_else(F.col("product_category"), F.lit(NO_CATEGORY)).alias("category_label"),
        _or_else(F.col("product_category"), F.lit(NO_CATEGORY_LEGEND)).alias("legend_label"),
        format_money(F.col("revenue")).alias("revenue_text"),
    )
