"""The star as managed tables of the session's catalog: typed, commented, published in one step.

A load makes new tables and changes nothing else until it is checked; then one property of the database
names their version. Readers ask for that property first, so they see the three tables of one load.
The catalog keeps no NOT NULL for Parquet tables: which columns must be filled is a property of the table,
and a load that breaks it is not published.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallymart import schema
from tallymart.operators import verify
from tallymart.sources.files import catalog, typed
from tallymart.sources.star import Star

PUBLISHED, FILLED = "published", "required"

# The columns that must not be empty.
REQUIRED = {
    "stores": ["store_id", "store_name"],
    "products": ["product_id", "product_name"],
    "sales": ["order_id", "date", "store_id", "product_id", "qty", "amount"],
}
KINDS = {"stores": schema.STORES, "products": schema.PRODUCTS, "sales": schema.SALES}
COMMENTS = {
    "store_id": "normalised id of a store", "product_id": "normalised id of a product", "order_id": "an order may have several rows",
    "date": "day of the sale", "qty": "units, above 0", "amount": "money, above 0", "unit_price": "null where unreadable",
}


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_database(spark: SparkSession, database: str, location: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quoted(database)} LOCATION {_text(location)}")


def load_tables(star: Star, database: str) -> Star:
    """Write the star as tables of a new version, check it, and publish it; a broken rule raises and publishes nothing."""
    spark = star.sales.sparkSession
    version = f"v{time.time_ns():020d}_{uuid.uuid4().hex[:8]}"
    for name, table in star.tables().items():
        columns = [_column(field) for field in KINDS[name]]
        place = f"{_quoted(database)}.{_quoted(f'{name}_{version}')}"
        required = f"TBLPROPERTIES ({_text(FILLED)} = {_text(','.join(REQUIRED[name]))})"
        spark.sql(f"CREATE TABLE {place} ({', '.join(columns)}) USING parquet COMMENT {_text(f'{name}, one load')} {required}")
        typed(table, KINDS[name]).write.insertInto(f"{database}.{name}_{version}")
    loaded = _version(spark, database, version)
    verify.require_valid(loaded)
    spark.sql(f"ALTER DATABASE {_quoted(database)} SET DBPROPERTIES ({_text(PUBLISHED)} = {_text(version)})")
    return loaded


def _column(field: T.StructField) -> str:
    comment = f" COMMENT {_text(COMMENTS[field.name])}" if field.name in COMMENTS else ""
    return f"{_quoted(field.name)} {field.dataType.simpleString()}{comment}"


def _version(spark: SparkSession, database: str, version: str) -> Star:
    return Star(*[spark.table(f"{database}.{name}_{version}") for name in ("sales", "stores", "products")])


def published(spark: SparkSession, database: str) -> str:
    """The version that readers use; none raises."""
    rows = spark.sql(f"DESCRIBE DATABASE EXTENDED {_quoted(database)}").collect()
    properties = next((r["info_value"] for r in rows if r["info_name"] == "Properties"), "")
    for part in properties.strip("()").split("),"):
        name, _, value = part.strip(" ()").partition(",")
        if name == PUBLISHED:
            return value.strip()
    raise ValueError(f"nothing published in {database}")


def read_tables(spark: SparkSession, database: str) -> Star:
    return _version(spark, database, published(spark, database))


def listing(spark: SparkSession, database: str) -> DataFrame:
    """Tables and columns of the published load as the catalog has them, with filled cells and rows.

    Rows (table_name, position, column_name, data_type, required, comment, filled_rows, row_count).
    """
    version = published(spark, database)
    entries = []
    tables = {}
    for table in spark.catalog.listTables(database):
        name, _, made = table.name.partition("_")
        if made != version:
            continue
        tables[name] = spark.table(f"{database}.{table.name}")
        kept = spark.sql(f"SHOW TBLPROPERTIES {_quoted(database)}.{_quoted(table.name)} ({_text(FILLED)})").first()["value"].split(",")
        for position, column in enumerate(spark.catalog.listColumns(f"{database}.{table.name}")):
            entries.append((name, position, column.name, column.dataType, column.name in kept, column.description))
    kinds = "table_name string, position bigint, column_name string, data_type string, required boolean, comment string"
    counted = catalog(tables).select("table_name", "column_name", "filled_rows", "row_count")
    return spark.createDataFrame(entries, kinds).join(counted, ["table_name", "column_name"])
