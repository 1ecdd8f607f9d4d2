"""Parameterised fact queries over the star.

Dates are loose bounds (unusable ones are ignored). Names are matched the way users type them;
a name that matches nothing empties a query about one entity but does not filter a ranking.
Where the grouping key is a dimension's key, sales are aggregated first and the dimension joins
the result, so the fact is shuffled at most once and already combined. Rankings take any positive
limit, and None for all rows.
"""

from __future__ import annotations

from calendar import monthrange
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.functions.bounds import between, between_loose, by, first_rows
from tallymart.functions.metrics import TOTAL, as_average, as_revenue, measure
from tallymart.functions.sizes import broadcast_if_small
from tallymart.operators.resolve import best_category, best_name
from tallymart.sources.star import Star

MONTH_FORMAT = "yyyy-MM"


def _only(sales: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Sales of the selected dimension rows. The selection is usually tiny even where the
    dimension is not, which only measuring can tell."""
    return sales.join(broadcast_if_small(dimension.select(key)), key, "left_semi")


def _named(dimension: DataFrame, column: str, name: Column) -> DataFrame:
    return dimension.where(F.lower(F.col(column)) == F.lower(name))


def _named_or_all(dimension: DataFrame, column: str, name: Column) -> DataFrame:
    same = F.lower(F.col(column)) == F.lower(name)
    return dimension.where(F.coalesce(same, name.isNull()))


def _per_product(sales: DataFrame, products: DataFrame, *columns: str) -> DataFrame:
    named = products.select("product_id", "product_name", "product_category")
    return (
        measure(sales, "product_id")
        .join(named, "product_id")
        .withColumn("revenue", as_revenue())
        .select(*columns)
    )


def product_rank(
    star: Star, order="desc", limit=1, category=None, start_date=None, end_date=None
) -> DataFrame:
    """Products by revenue, optionally of one category."""
    return _product_ranking(star, "revenue", order, limit, None, category, start_date, end_date)


def product_quantity(
    star: Star,
    product_name=None,
    category=None,
    order="desc",
    limit=1,
    start_date=None,
    end_date=None,
) -> DataFrame:
    """Products by quantity sold, optionally of one name or category."""
    return _product_ranking(
        star, "qty", order, limit, product_name, category, start_date, end_date
    )


def _product_ranking(star, by_column, order, limit, name, category, start, end) -> DataFrame:
    sales = between_loose(star.sales, start, end)
    products = star.products
    if name:
        products = _named_or_all(
            products, "product_name", best_name(star.products, "product_name", name)
        )
    if category:
        products = _named_or_all(
            products, "product_category", best_category(star.products, category)
        )
    if name or category:
        sales = _only(sales, products, "product_id")
    measures = ["revenue", "qty"] if by_column == "revenue" else ["qty", "revenue"]
    rows = _per_product(
        sales, products, "product_id", "product_name", "product_category", *measures, "order_count"
    )
    return first_rows(rows.orderBy(by(by_column, order), "product_id"), limit)


def _of_product(star: Star, name: object, start: object, end: object) -> tuple[DataFrame, DataFrame]:
    products = _named(
        star.products, "product_name", best_name(star.products, "product_name", name)
    )
    sales = between_loose(star.sales, start, end)
    return _only(sales, products, "product_id"), products


def product_revenue(star: Star, product_name, start_date=None, end_date=None) -> DataFrame:
    """Every product of the name, with its measures."""
    sales, products = _of_product(star, product_name, start_date, end_date)
    return _per_product(
        sales,
        products,
        "product_id",
        "product_name",
        "product_category",
        "revenue",
        "qty",
        "order_count",
    )


def product_orders(star: Star, product_name, start_date=None, end_date=None) -> DataFrame:
    """As product_revenue, orders first and without the category."""
    sales, products = _of_product(star, product_name, start_date, end_date)
    return _per_product(
        sales, products, "product_id", "product_name", "order_count", "qty", "revenue"
    )


def _over_time(star: Star, name, start, end, period: str, unit: Column) -> DataFrame:
    # Products that share a name count as one, so the name joins before the aggregate. The
    # semi join stays in front of it: it can sink below joins inside the sales frame.
    sales, products = _of_product(star, name, start, end)
    names = broadcast_if_small(products.select("product_id", "product_name"))
    return (
        measure(sales.join(names, "product_id"), unit.alias(period), "product_name")
        .withColumn("revenue", as_revenue())
        .select(period, "product_name", "revenue", "qty", "order_count")
        .orderBy(period, "product_name")
    )


def product_monthly_sales(star: Star, product_name, start_date=None, end_date=None) -> DataFrame:
    return _over_time(
        star, product_name, start_date, end_date, "month", F.trunc("date", "MM")
    ).withColumn("month", F.date_format("month", MONTH_FORMAT))


def product_daily_sales(star: Star, product_name, start_date=None, end_date=None) -> DataFrame:
    return _over_time(star, product_name, start_date, end_date, "date", F.col("date"))


def product_revenue_month(star: Star, product_name, month: str) -> DataFrame:
    """product_revenue within one month, given as YYYY-MM."""
    first = date.fromisoformat(f"{month}-01")
    last = first.replace(day=monthrange(first.year, first.month)[1])
    in_month = between(star.sales, first, last)
    return product_revenue(Star(in_month, star.stores, star.products), product_name)


def _per_category(sales: DataFrame, products: DataFrame) -> DataFrame:
    # An order may hold several products of a category: the category must be known before
    # orders are counted.
    categories = products.select("product_id", F.col("product_category").alias("category"))
    return (
        measure(sales.join(categories, "product_id"), "category")
        .withColumn("revenue", as_revenue())
        .select("category", "revenue", "qty", "order_count")
    )


def category_rank(star: Star, order="desc", limit=1, start_date=None, end_date=None) -> DataFrame:
    """Categories by revenue."""
    sales = between_loose(star.sales, start_date, end_date)
    rows = _per_category(sales, star.products)
    return first_rows(rows.orderBy(by("revenue", order), "category"), limit)


def category_revenue(star: Star, category, start_date=None, end_date=None) -> DataFrame:
    """One category with its measures."""
    products = _named(star.products, "product_category", best_category(star.products, category))
    sales = between_loose(star.sales, start_date, end_date)
    return _per_category(_only(sales, products, "product_id"), products)


def category_performance(star: Star) -> DataFrame:
    """All categories by unrounded sales."""
    categories = star.products.select("product_id", "product_category")
    return (
        measure(star.sales.join(categories, "product_id"), "product_category")
        .select(
            "product_category",
            F.col(TOTAL).cast("double").alias("total_sales"),
            F.col("qty").alias("total_qty"),
            F.col("order_count").alias("total_orders"),
        )
        .orderBy(F.desc_nulls_last("total_sales"), "product_category")
    )


def _per_store(sales: DataFrame, stores: DataFrame) -> DataFrame:
    return (
        measure(sales, "store_id")
        .join(stores.select("store_id", "store_name"), "store_id")
        .withColumn("revenue", as_revenue())
        .select("store_id", "store_name", "revenue", "qty", "order_count")
    )


def store_rank(star: Star, order="desc", limit=1, start_date=None, end_date=None) -> DataFrame:
    """Stores by revenue."""
    sales = between_loose(star.sales, start_date, end_date)
    rows = _per_store(sales, star.stores)
    return first_rows(rows.orderBy(by("revenue", order), "store_id"), limit)


def store_revenue(star: Star, store_name, start_date=None, end_date=None) -> DataFrame:
    """Every store of the name, with its measures."""
    stores = _named(star.stores, "store_name", best_name(star.stores, "store_name", store_name))
    sales = between_loose(star.sales, start_date, end_date)
    return _per_store(_only(sales, stores, "store_id"), stores)


def daily_sales(star: Star, start_date=None, end_date=None) -> DataFrame:
    """Revenue, orders and average order value per day."""
    dated = star.sales.where(F.col("date").isNotNull())
    return (
        measure(between_loose(dated, start_date, end_date), "date")
        .select(
            "date",
            as_revenue().alias("revenue"),
            "order_count",
            as_average().alias("average_order_value"),
        )
        .orderBy("date")
    )


def monthly_sales(star: Star, start_date=None, end_date=None) -> DataFrame:
    """Revenue, quantity, orders and average order value per month."""
    dated = star.sales.where(F.col("date").isNotNull())
    months = measure(between_loose(dated, start_date, end_date), F.trunc("date", "MM").alias("month"))
    return (
        months.select(
            "month",
            as_revenue().alias("revenue"),
            "qty",
            "order_count",
            as_average().alias("average_order_value"),
        )
        .orderBy("month")
        .withColumn("month", F.date_format("month", MONTH_FORMAT))
    )


def aov_trend(star: Star, start_date=None, end_date=None) -> DataFrame:
    """The daily rows a trend verdict is read from."""
    return daily_sales(star, start_date, end_date)


def payment_sales(star: Star, start_date=None, end_date=None) -> DataFrame:
    """Measures per payment method; sales without one form their own group."""
    return (
        measure(between_loose(star.sales, start_date, end_date), "payment")
        .withColumn("revenue", as_revenue())
        .select("payment", "revenue", "qty", "order_count")
        .orderBy(F.desc_nulls_last("revenue"), "payment")
    )


def dataset_summary(star: Star) -> DataFrame:
    """Row counts of the three tables and the range of dates."""

    def rows(table: DataFrame) -> Column:
        return table.agg(F.count(F.lit(1))).scalar()

    return star.sales.agg(
        F.count(F.lit(1)).alias("sales_rows"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
    ).select(
        "sales_rows",
        rows(star.stores).alias("store_count"),
        rows(star.products).alias("product_count"),
        "min_date",
        "max_date",
    )
