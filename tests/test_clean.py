from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallymart import schema
from tallymart.operators import clean, verify
from tallymart.plans import batch
from tallymart.sources import files, sample
from tallymart.sources.star import Star
from tests.conftest import CLEAN, PRODUCTS, STORES, values_of

FUNNEL = {
    "in": 14, "raw_duplicates": 1, "invalid_date": 1, "invalid_qty": 3, "invalid_amount": 2,
    "invalid_store": 1, "invalid_product": 1, "final_duplicates": 1, "out": 4,
}


def by_text(rows):
    return sorted(rows, key=str)


def test_cleaned_rows(raw):
    assert by_text(values_of(batch.clean_star(raw).sales)) == by_text(CLEAN)


def test_funnel(raw):
    assert dict(values_of(clean.funnel(raw.sales, raw.stores, raw.products))) == FUNNEL


def test_rejects_name_the_first_broken_rule(raw):
    rejected = clean.rejects(raw.sales, raw.stores, raw.products)
    reasons = {row["order_id"]: row["reject_reason"] for row in rejected.collect()}
    assert reasons == {
        "O3": "invalid_date", "O4": "invalid_qty", "O5": "invalid_qty", "O6": "invalid_amount",
        "O7": "invalid_amount", "O8": "invalid_store", "O9": "invalid_product",
        "O11": "invalid_qty",
    }


def test_half_a_piece_is_kept_as_zero(spark, raw):
    rows = [("A", "2026-05-01", "S01", "P01", "0.5", "0.001", None)]
    sales = spark.createDataFrame(rows, schema.RAW_SALES)
    [row] = clean.clean_sales(sales, raw.stores, raw.products).collect()
    assert (row["qty"], float(row["amount"])) == (0, 0.0)


def test_numbers_too_large_are_invalid(spark, raw):
    rows = [
        ("A", "2026-05-01", "S01", "P01", "1e30", "5", None),
        ("B", "2026-05-01", "S01", "P01", "1", "1e30", None),
        ("C", "2026-05-01", None, "P01", "1", "5", None),
    ]
    sales = spark.createDataFrame(rows, schema.RAW_SALES)
    rejected = clean.rejects(sales, raw.stores, raw.products)
    assert {r["order_id"]: r["reject_reason"] for r in rejected.collect()} == {
        "A": "invalid_qty", "B": "invalid_amount", "C": "invalid_store",
    }
    assert clean.clean_sales(sales, raw.stores, raw.products).count() == 0


def test_empty_input(spark, raw):
    empty = spark.createDataFrame([], schema.RAW_SALES)
    assert clean.clean_sales(empty, raw.stores, raw.products).count() == 0
    funnel = dict(values_of(clean.funnel(empty, raw.stores, raw.products)))
    assert set(funnel.values()) == {0}


def test_dimensions_as_shipped_stay(raw):
    cleaned = batch.clean_star(raw)
    assert by_text(values_of(cleaned.stores)) == by_text(STORES)
    assert by_text(values_of(cleaned.products)) == by_text(
        [(i, n, c, float(p)) for i, n, c, p in PRODUCTS]
    )


def test_first_row_per_key_by_sequence(spark):
    rows = [(" s1", "later", None, None, 2), ("S1", "first", None, None, 1), ("s2", "x", None, None, 3)]
    df = spark.createDataFrame(rows, "store_id string, store_name string, category string, district string, seq int")
    kept = {r["store_id"]: r["store_name"] for r in clean.clean_stores(df, order="seq").collect()}
    assert kept == {"S1": "first", "S2": "x"}


def test_unreadable_price_becomes_null(spark):
    df = spark.createDataFrame([("p1", "n", "c", "12d")], schema.RAW_PRODUCTS)
    assert values_of(clean.clean_products(df)) == [("P1", "n", "c", None)]


def test_csv_round_trip(spark, raw, tmp_path):
    path = str(tmp_path / "sales")
    files.write_csv(raw.sales, path)
    again = files.read_raw_csv(spark, path, schema.RAW_SALES)
    assert by_text(values_of(again)) == by_text(values_of(raw.sales))


def test_csv_byte_order_mark_and_missing_markers(spark, tmp_path):
    path = tmp_path / "stores.csv"
    path.write_bytes(
        '﻿store_id,store_name,category,district\nS1,"a ""b"", c",N/A,\n'.encode()
    )
    read = files.read_raw_csv(spark, str(path), schema.RAW_STORES)
    assert values_of(read) == [("S1", 'a "b", c', None, None)]


def test_load_and_read_back(spark, raw, tmp_path):
    loaded = files.load(batch.clean_star(raw), str(tmp_path / "layer"))
    assert by_text(values_of(loaded.sales.drop("month"))) == by_text(CLEAN)
    assert sorted(p.name for p in (tmp_path / "layer" / "versions").glob("*/sales/month=*")) == [
        "month=2026-05", "month=2026-07",
    ]
    assert dict(values_of(verify.row_counts(loaded))) == {"sales": 4, "stores": 5, "products": 9}


def test_load_refuses_broken_references(spark, star, tmp_path):
    folder = str(tmp_path / "layer")
    files.load(star, folder)
    orphaned = Star(star.sales, star.stores.where("store_id <> 'S05'"), star.products)
    with pytest.raises(ValueError, match="sales.store_id reference: 1"):
        files.load(orphaned, folder)
    published = files.read_published(spark, folder)
    assert published.stores.count() == 5 and published.sales.count() == 4
    files.load(Star(star.sales.where("order_id = 'O1'"), star.stores, star.products), folder)
    assert files.read_published(spark, folder).sales.count() == 1


def test_load_refuses_null_cells_that_its_write_counts(spark, star, tmp_path):
    folder = str(tmp_path / "layer")
    lost = Star(star.sales.withColumn("qty", F.expr("if(order_id = 'O1', null, qty)")), star.stores, star.products)
    nulls = lost.sales.where("qty is null").count()
    assert nulls
    with pytest.raises(ValueError, match=f"sales.qty not_null: {nulls}$"):
        files.load(lost, folder)
    empty = files.load(Star(star.sales.where("false"), star.stores, star.products), folder)
    assert empty.sales.count() == 0 and files.read_published(spark, folder).stores.count() == 5


def test_csv_by_name(spark, tmp_path):
    path = tmp_path / "stores.csv"
    path.write_text("extra,district,store_id\n1,North,S1\n2,NA,S2\n")
    read = files.read_raw_csv(spark, str(path), schema.RAW_STORES)
    assert read.columns == ["store_id", "district"]
    assert values_of(read) == [("S1", "North"), ("S2", None)]
    assert files.absent(read, schema.RAW_STORES) == ["store_name", "category"]


def test_csv_with_byte_order_mark(spark, tmp_path):
    path = str(tmp_path / "out")
    files.write_csv(spark.createDataFrame(STORES, schema.RAW_STORES), path, byte_order_mark=True)
    parts = [p.read_bytes() for p in (tmp_path / "out").glob("part-*")]
    assert parts and all(p.startswith(b"\xef\xbb\xbfstore_id,") for p in parts if p)
    assert by_text(values_of(files.read_raw_csv(spark, path, schema.RAW_STORES))) == by_text(STORES)


def test_session_tables(spark, star):
    star.stores.createOrReplaceTempView("listed_stores")
    rows = values_of(files.session_tables(spark).where("table_name = 'listed_stores'"))
    assert [r[3] for r in sorted(rows, key=lambda r: r[2])] == schema.STORE_COLUMNS
    spark.catalog.dropTempView("listed_stores")


def test_constraints_and_orphans(spark, star):
    from tallymart.sources.star import Star

    twice = Star(
        star.sales.withColumn("store_id", F.when(F.col("order_id") != "O1", F.col("store_id"))),
        star.stores.where("store_id <> 'S05'"),
        star.products.unionAll(star.products.where("product_id = 'P01'")),
    )
    broken = {
        (r["table_name"], r["rule"], r["column_name"]): r["violations"]
        for r in verify.constraints(twice).where("violations > 0").collect()
    }
    assert broken == {
        ("sales", "not_null", "store_id"): 1,
        ("products", "unique", "product_id"): 1,
        ("sales", "reference", "store_id"): 1,
    }
    assert dict(values_of(verify.orphans(twice))) == {"stores": 2, "products": 0}


def test_funnel_agrees_with_cleaning_on_whole_sample(spark):
    folder = "/root/testdata/sf0.001"
    sales = sample.raw_sales(spark, folder)
    stores, products = sample.raw_stores(spark, folder), sample.raw_products(spark, folder)
    funnel = dict(values_of(clean.funnel(sales, stores, products)))
    assert funnel["out"] == clean.clean_sales(sales, stores, products).count()
    assert funnel["final_duplicates"] > 0
    assert funnel["in"] == sales.count() == sum(v for k, v in funnel.items() if k != "in")
