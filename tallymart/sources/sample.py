"""The star schema derived from order-line tables, clean and deliberately dirty.

Maps ``lineitem``/``orders`` to sales, ``supplier``/``nation``/``region`` to stores and ``part``
to products. All frames are lazy and cover the whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallymart.functions import values
from tallymart.functions.sizes import broadcast_if_small
from tallymart.schema import MONEY, SALES_COLUMNS
from tallymart.sources.star import Star


# Schemas of the tables read so far; the tables are read-only. Knowing the schema saves a job
# per table that only looks at a file footer.
_SCHEMAS: dict[str, StructType] = {}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = read(spark, folder, "lineitem")
    orders = read(spark, folder, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey)


def sales(spark: SparkSession, folder: str) -> DataFrame:
    # Columns get their names and types before the join: a semi join on the result can then
    # sink to the side it belongs to.
    lines = read(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_suppkey").alias("store_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("bigint").alias("qty"),
        F.col("l_extendedprice").cast(MONEY).alias("amount"),
    )
    orders = read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_orderpriority").alias("payment"),
    )
    return lines.join(orders, "order_id").select(*SALES_COLUMNS)


def stores(spark: SparkSession, folder: str) -> DataFrame:
    supplier = read(spark, folder, "supplier")
    nation = read(spark, folder, "nation")
    region = read(spark, folder, "region")
    return (
        supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(
            F.col("s_suppkey").alias("store_id"),
            F.col("s_name").alias("store_name"),
            F.col("r_name").alias("category"),
            F.col("n_name").alias("district"),
        )
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("product_category"),
        F.col("p_retailprice").alias("unit_price"),
    )


def star(spark: SparkSession, folder: str) -> Star:
    """The processed layer: typed, complete, with numeric ids."""
    return Star(sales(spark, folder), stores(spark, folder), products(spark, folder))


def _every(col: Column, n: int) -> Column:
    return col % n == 0


def raw_sales(spark: SparkSession, folder: str) -> DataFrame:
    """All sales as text with dirt by fixed rules on their keys (FIXTURES.md, section 7)."""
    k, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    day = F.col("o_orderdate").cast("date")
    amount = F.col("l_extendedprice").cast(MONEY).cast("string")
    ids = F.concat(F.lit("O"), k.cast("string"))

    dirty = _lines(spark, folder).select(
        k.alias("k"),
        F.when(_every(k, 23), F.concat(F.lit(" o"), k.cast("string"))).otherwise(ids).alias("order_id"),
        F.when(_every(k, 211), "n/a")
        .when(k % 7 == 1, F.date_format(day, "yyyy/MM/dd"))
        .when(k % 7 == 2, F.date_format(day, "yyyy.MM.dd"))
        .when(k % 7 == 3, F.date_format(day, "dd-MM-yyyy"))
        .when(k % 7 == 4, F.date_format(day, "dd/MM/yyyy"))
        .when(k % 7 == 5, F.date_format(day, "dd.MM.yyyy"))
        .otherwise(day.cast("string"))
        .alias("date"),
        F.when(_every(k, 173), "S999999")
        .when(_every(k, 31), F.concat(F.lit("s"), s.cast("string")))
        .otherwise(F.concat(F.lit("S"), s.cast("string")))
        .alias("store_id"),
        F.when(_every(p, 97), "P999999")
        .otherwise(F.concat(F.lit("P"), p.cast("string")))
        .alias("product_id"),
        F.when(_every(p, 59), "0")
        .when(_every(p, 61), "x")
        .otherwise(F.col("l_quantity").cast("bigint").cast("string"))
        .alias("qty"),
        F.when(_every(p, 53), F.lit(None).cast("string"))
        .when(_every(p, 47), F.concat(F.lit("-"), amount))
        .when(_every(p, 43), F.concat(F.lit("¥"), amount))
        .when(_every(p, 41), F.concat(F.lit("￥"), amount))
        .when(_every(p, 37), "bad")
        .when(
            _every(p, 29) & (F.length(amount) > 6),
            F.regexp_replace(amount, r"^(\d+)(\d{3}\.\d{2})$", "$1,$2"),
        )
        .otherwise(amount)
        .alias("amount"),
        F.col("o_orderpriority").alias("payment"),
    )
    # Copies: every row of every 17th order twice, and every 19th order once more with its id
    # in lower case, which only cleaning recognises as the same row.
    copies = (
        F.when(_every(F.col("k"), 17), F.array(F.lit("same"), F.lit("same")))
        .otherwise(F.array(F.lit("same")))
    )
    lowered = F.when(_every(F.col("k"), 19), F.array(F.lit("lower"))).otherwise(
        F.array().cast("array<string>")
    )
    copied = dirty.withColumn("copy", F.explode(F.concat(copies, lowered)))
    return copied.select(
        F.when(F.col("copy") == "lower", F.concat(F.lit("o"), F.col("k").cast("string")))
        .otherwise(F.col("order_id"))
        .alias("order_id"),
        "date", "store_id", "product_id", "qty", "amount", "payment",
    )


def raw_stores(spark: SparkSession, folder: str) -> DataFrame:
    text = stores(spark, folder).withColumn(
        "store_id", F.concat(F.lit("S"), F.col("store_id").cast("string"))
    )
    return broadcast_if_small(text)


def raw_products(spark: SparkSession, folder: str) -> DataFrame:
    return products(spark, folder).select(
        F.concat(F.lit("P"), F.col("product_id").cast("string")).alias("product_id"),
        "product_name",
        "product_category",
        F.col("unit_price").cast(MONEY).cast("string").alias("unit_price"),
    )


def unchecked(spark: SparkSession, folder: str) -> Star:
    """Raw sales with ids normalised and cells typed, but nothing rejected: a star with
    unknown references, null dates and null amounts."""
    raw = raw_sales(spark, folder)
    cells = {
        "order_id": values.normalize_id(F.col("order_id")),
        "date": values.parse_date(F.col("date")),
        "store_id": values.normalize_id(F.col("store_id")),
        "product_id": values.normalize_id(F.col("product_id")),
        "qty": values.number(F.col("qty")).try_cast("bigint"),
        "amount": values.money(F.col("amount")),
    }
    return Star(
        sales=values.computed_once(raw, cells, [F.col("payment")]).select(*SALES_COLUMNS),
        stores=raw_stores(spark, folder),
        products=raw_products(spark, folder),
    )
