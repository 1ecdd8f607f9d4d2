"""The report as a document, tables of the catalog, and the layout of the fact."""

from __future__ import annotations

import json
import time
from datetime import date, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallymart import schema
from tallymart.operators import document
from tallymart.plans import batch
from tallymart.sources import files, tables
from tallymart.sources.star import Star


def test_document_has_the_report_in_one_row(spark, raw, tmp_path):
    path = str(tmp_path / "document")
    batch.audit_document(raw).write.json(path)
    (line,) = [r["value"] for r in spark.read.text(path).collect()]
    made = json.loads(line)
    assert list(made) == ["sales", "stores", "products"]
    sales = made["sales"]
    assert list(sales) == ["basic_info", "missing_values", "duplicate_rows", "order_id", "dates", "foreign_keys", "qty", "amount"]
    assert sales["basic_info"]["row_count"] == 14 and sales["basic_info"]["columns"] == schema.SALES_COLUMNS
    assert sales["missing_values"]["amount"] == {"missing_count": 1, "missing_rate": 0.071429}
    assert sales["duplicate_rows"] == 2 and sales["order_id"]["exists"] is True
    assert sales["dates"]["date_format_separator_stats"] == {"-": 12, "/": 1, ".": 1, "other": 0}
    assert sales["foreign_keys"]["store_id"] == {
        "exists": True, "reference_column_exists": True, "invalid_count": 3,
        "invalid_values": [{"value": "S99", "row_count": 2}, {"value": "s01", "row_count": 1}],
    }
    assert made["products"]["primary_key"] == {"column": "product_id", "duplicate_count": 0}
    assert made["stores"]["basic_info"]["dtypes"]["store_name"] == "str"


def test_ranks_order_by_count_then_value(spark):
    rows = [("sales", "foreign_keys", k, f"invalid_value {v}", str(n)) for k, v, n in [
        ("a", "x", 5), ("a", "y", 7), ("a", "", 5), ("b", "q", 1), ("a", "invalid_value z", 10),
    ]] + [("sales", "qty", "qty", "missing_count", "3")]
    report = spark.createDataFrame(rows, "table_name string, section string, column_name string, metric string, value string")
    got = sorted((r["column_name"], r["rank"], r["value"], r["row_count"]) for r in document.ranked_values(report).collect())
    assert got == [("a", 1, "invalid_value z", 10), ("a", 2, "y", 7), ("a", 3, "", 5), ("a", 4, "x", 5), ("b", 1, "q", 1)]


def test_a_long_histogram_stays_in_rows(spark, raw):
    report = batch.audit_report(raw)
    columns = {name: table.columns for name, table in raw.tables().items()}
    short = document.document(report, columns, listed=1).first()["sales"]["foreign_keys"]
    assert short["store_id"]["invalid_values"] is None and short["store_id"]["invalid_count"] == 3
    assert document.ranked_values(report).where("column_name = 'store_id'").count() == 2


def test_document_lists_every_unknown_reference(spark, raw):
    many = spark.range(1, 1502).select(F.lit("O1").alias("order_id"), F.lit("2026-05-01").alias("date"),
        F.format_string("X%04d", "id").alias("store_id"), F.lit("P01").alias("product_id"),
        F.lit("1").alias("qty"), F.lit("2").alias("amount"), F.lit("card").alias("payment"))
    twice = many.where("store_id = 'X1200'").unionByName(many)
    keys = batch.audit_document(Star(twice, raw.stores, raw.products)).first()["sales"]["foreign_keys"]
    expected = [("X1200", 2), *((f"X{i:04d}", 1) for i in range(1, 1502) if i != 1200)]
    assert keys["store_id"]["invalid_count"] == 1502 and [tuple(v) for v in keys["store_id"]["invalid_values"]] == expected
    assert keys["product_id"]["invalid_values"] == []


@pytest.fixture
def database(spark, tmp_path):
    name = f"d{time.time_ns()}"
    tables.create_database(spark, name, str(tmp_path / "it's a folder"))
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_tables_are_published_together_and_listed(spark, star, database):
    with pytest.raises(ValueError, match="nothing published"):
        tables.read_tables(spark, database)
    tables.load_tables(star, database)
    read = tables.read_tables(spark, database)
    for name, table in star.tables().items():
        assert sorted(map(str, read.tables()[name].collect())) == sorted(map(str, table.collect()))
    rows = {(r["table_name"], r["column_name"]): r for r in tables.listing(spark, database).collect()}
    assert len(rows) == 15
    amount = rows["sales", "amount"]
    assert (amount["data_type"], amount["required"], amount["comment"], amount["filled_rows"]) == ("decimal(18,2)", True, "money, above 0", 4)
    assert rows["sales", "payment"]["required"] is False and rows["sales", "payment"]["filled_rows"] == 3
    # A dropped column shows: the listing is the catalog's.
    version = tables.published(spark, database)
    spark.sql(f"ALTER TABLE {database}.stores_{version} ADD COLUMN opened date")
    assert ("stores", "opened") in {(r["table_name"], r["column_name"]) for r in tables.listing(spark, database).collect()}


def test_a_refused_load_changes_nothing(spark, star, database):
    tables.load_tables(star, database)
    version = tables.published(spark, database)
    broken = Star(star.sales.withColumn("store_id", F.lit("S77")), star.stores, star.products)
    with pytest.raises(ValueError):
        tables.load_tables(broken, database)
    assert tables.published(spark, database) == version
    smaller = Star(star.sales.where("order_id = 'O1'"), star.stores, star.products)
    tables.load_tables(smaller, database)
    assert tables.published(spark, database) != version and tables.read_tables(spark, database).sales.count() == 1


@pytest.fixture(scope="module")
def many(spark):
    n = 200_000
    k = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit("O"), F.pmod(k * 7919, F.lit(n // 3))).alias("order_id"),
        F.date_add(F.lit(date(2026, 5, 1)), F.pmod(F.xxhash64(k), F.lit(60)).cast("int")).alias("date"),
        F.concat(F.lit("S"), F.pmod(F.xxhash64(k, F.lit(1)), F.lit(9000))).alias("store_id"),
        F.concat(F.lit("P"), F.pmod(F.xxhash64(k, F.lit(2)), F.lit(900))).alias("product_id"),
        F.lit(1).cast("bigint").alias("qty"), F.lit(5).cast(schema.MONEY).alias("amount"), F.lit("card").alias("payment"),
    ).cache()


def rows_read(df):
    """Rows that the scan gives to the filter above it: those of the row groups not skipped."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    found, nodes = [], [plan]
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("Scan"):
            found.append(node.metrics().apply("numOutputRows").value())
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return sum(found)


def test_lookups_skip_row_groups(spark, many, tmp_path):
    """Small row groups, as a large table has many of."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.setInt("parquet.block.size", 64 * 1024)
    spent = {}
    try:
        for kind in (False, True, False, True):
            path, started = str(tmp_path / f"sales-{kind}-{len(spent)}"), time.perf_counter()
            files.write_sales(many, path, clustered=kind)
            spent.setdefault(kind, []).append((time.perf_counter() - started, path))
    finally:
        hadoop.unset("parquet.block.size")
    plain, clustered = spent[False][-1][1], spent[True][-1][1]
    groups = sum(pq.ParquetFile(p).num_row_groups for p in (tmp_path / clustered.rsplit("/", 1)[1]).rglob("*.parquet"))
    assert groups > 10
    wanted = {"product_id": "P123", "store_id": "S4567", "order_id": "O4242"}
    for column, value in wanted.items():
        seen = {}
        for path in (plain, clustered):
            found = spark.read.parquet(path).where(F.col(column) == value)
            seen[path] = rows_read(found)
            assert found.count() == many.where(F.col(column) == value).count() > 0
        assert seen[clustered] < 0.5 * seen[plain], column
    assert timedelta(seconds=min(s for s, _ in spent[True])) < 3 * timedelta(seconds=min(s for s, _ in spent[False]))
