"""Column layouts of the raw and the processed tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The column names of the three tables, in file order.
SALES_COLUMNS = ["order_id", "date", "store_id", "product_id", "qty", "amount", "payment"]
STORE_COLUMNS = ["store_id", "store_name", "category", "district"]
PRODUCT_COLUMNS = ["product_id", "product_name", "product_category", "unit_price"]

MONEY = T.DecimalType(18, 2)


def all_text(columns: list[str]) -> T.StructType:
    """Raw tables are read as text so that dirty values survive until they are judged."""
    return T.StructType([T.StructField(name, T.StringType()) for name in columns])


RAW_SALES = all_text(SALES_COLUMNS)
RAW_STORES = all_text(STORE_COLUMNS)
RAW_PRODUCTS = all_text(PRODUCT_COLUMNS)

SALES = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("store_id", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("qty", T.LongType()),
        T.StructField("amount", MONEY),
        T.StructField("payment", T.StringType()),
    ]
)
STORES = all_text(STORE_COLUMNS)
PRODUCTS = T.StructType(
    [
        T.StructField("product_id", T.StringType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("product_category", T.StringType()),
        T.StructField("unit_price", T.DoubleType()),
    ]
)
