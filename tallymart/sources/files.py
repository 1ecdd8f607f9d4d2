"""Raw CSV in, processed tables in and out."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymart import schema
from tallymart.operators import verify
from tallymart.sources.star import Star

# Cell texts that count as missing when a raw CSV is read.
MISSING_MARKERS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]


# Columns of the fact that point lookups ask for, besides the one that rows are sorted by.
LOOKED_UP = ["store_id", "order_id"]


def read_raw_csv(
    spark: SparkSession,
    path: str,
    columns: T.StructType,
    missing: list[str] = MISSING_MARKERS,
    multiline: bool = False,
) -> DataFrame:
    """Read the named columns of a headed CSV as text, in any order and among any others.

    A column that the header lacks is left out of the result; ``absent`` tells which. A missing
    path is an error, a byte order mark is ignored. Only the header is read ahead, and files of
    one folder share it. ``multiline`` admits line breaks inside quoted cells but makes files
    unsplittable.
    """
    raw = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("escape", '"')
        .option("multiLine", multiline)
        .csv(path)
    )
    mark = "\ufeff"
    there = {name.removeprefix(mark): name for name in raw.columns}
    cells = {f.name: F.col(f"`{there[f.name]}`") for f in columns if f.name in there}
    return raw.select(*[F.when(~cell.isin(missing), cell).alias(name) for name, cell in cells.items()])


def absent(df: DataFrame, columns: T.StructType) -> list[str]:
    """The expected columns that a table lacks."""
    return [f.name for f in columns if f.name not in df.columns]


def write_csv(df: DataFrame, path: str, byte_order_mark: bool = False) -> None:
    """Overwrite a folder of headed CSV parts, leaving white space in cells as it is.

    With ``byte_order_mark`` each part opens with one, as spreadsheets expect.
    """
    if byte_order_mark:
        first = df.columns[0]
        df = df.withColumnRenamed(first, "\ufeff" + first)
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def typed(df: DataFrame, target: T.StructType) -> DataFrame:
    """Cast to the table's declared types and column order."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target])


def write_sales(sales: DataFrame, path: str, clustered: bool = True, watch: Observation | None = None) -> None:
    """Overwrite the fact table, one folder per month for date pruning.

    The rebalance hint gathers each month before writing, so files are few, and lets AQE cut a
    month that outgrows the others into several tasks. Inside a month rows are sorted by product, so
    that the bounds of row groups tell most of them apart, and bloom filters tell which hold a store or
    an order: a lookup by any of the three skips row groups. The sort takes the place of the one by
    month that the write needs anyway.

    ``watch`` observes the null cells of required columns. It stands behind the last shuffle, where
    only finished tasks of the writing stage report, and before the sort, which the write must see.
    """
    placed = sales.withColumn("month", F.date_format("date", "yyyy-MM")).hint("rebalance", F.col("month"))
    if watch is not None:
        placed = placed.observe(watch, *verify.null_counts("sales"))
    if not clustered:
        placed.write.mode("overwrite").partitionBy("month").parquet(path)
        return
    writer = placed.sortWithinPartitions("month", "product_id", "order_id").write.mode("overwrite").partitionBy("month")
    for column in LOOKED_UP:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    # The filters fit what a row group holds.
    writer.option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)


def write_processed(star: Star, folder: str, watch: Observation | None = None) -> None:
    """Full refresh of the processed layer, dimensions first; ``watch`` as for ``write_sales``."""
    star.stores.write.mode("overwrite").parquet(f"{folder}/stores")
    star.products.write.mode("overwrite").parquet(f"{folder}/products")
    write_sales(star.sales, f"{folder}/sales", watch=watch)


def read_processed(spark: SparkSession, folder: str) -> Star:
    """Read the processed layer; the first missing table raises.

    ``month`` stays on the fact so that filters on it prune folders.
    """
    with_month = T.StructType([*schema.SALES.fields, T.StructField("month", T.StringType())])
    return Star(
        sales=spark.read.schema(with_month).parquet(f"{folder}/sales"),
        stores=spark.read.schema(schema.STORES).parquet(f"{folder}/stores"),
        products=spark.read.schema(schema.PRODUCTS).parquet(f"{folder}/products"),
    )


def load(star: Star, folder: str) -> Star:
    """Write the typed tables as a new version, check it, and publish it last.

    A broken rule raises and leaves the version unpublished, so readers keep the one before. Null
    cells of the fact are counted by its write; it is read again for its references only.
    """
    spark = star.sales.sparkSession
    watch = Observation()
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    place = f"{folder}/versions/{version}"
    write_processed(
        Star(
            sales=typed(star.sales, schema.SALES),
            stores=typed(star.stores, schema.STORES),
            products=typed(star.products, schema.PRODUCTS),
        ),
        place,
        watch,
    )
    loaded = read_processed(spark, place)
    verify.require_valid(loaded, watch.get)
    # Publishing adds one row, which the commit of the append makes visible at once.
    spark.createDataFrame([(version,)], _PUBLISHED).coalesce(1).write.mode("append").parquet(
        f"{folder}/published"
    )
    return loaded


def read_published(spark: SparkSession, folder: str) -> Star:
    """The newest version that a load below ``folder`` has published; none raises."""
    versions = spark.read.schema(_PUBLISHED).parquet(f"{folder}/published")
    return read_processed(spark, f"{folder}/versions/{versions.agg(F.max('version')).first()[0]}")


def session_tables(spark: SparkSession) -> DataFrame:
    """Tables and views that the session's current database lists, with their columns."""
    rows = [
        (table.name, table.tableType, position, column.name, column.dataType)
        for table in spark.catalog.listTables()
        for position, column in enumerate(spark.catalog.listColumns(table.name))
    ]
    return spark.createDataFrame(
        rows, "table_name string, kind string, position bigint, column_name string, data_type string"
    )


_PUBLISHED = "version string"


def catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """Table and column listing with the number of filled cells per column.

    One aggregate per table counts all its columns.
    """
    return reduce(DataFrame.unionByName, [_columns_of(n, t) for n, t in tables.items()])


def _columns_of(name: str, table: DataFrame) -> DataFrame:
    filled = table.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in table.columns]
    )
    entries = [
        F.struct(
            F.lit(name).alias("table_name"),
            F.lit(position).cast("bigint").alias("position"),
            F.lit(field.name).alias("column_name"),
            F.lit(field.dataType.simpleString()).alias("data_type"),
            F.col(field.name).alias("filled_rows"),
            F.col("_rows").alias("row_count"),
        )
        for position, field in enumerate(table.schema)
    ]
    return filled.select(F.inline(F.array(*entries)))
