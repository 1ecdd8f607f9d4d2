"""CSV rows with their places, malformed rows, and the one judged write."""

from __future__ import annotations

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tallymart import schema
from tallymart.operators import audit, clean
from tallymart.plans import batch
from tallymart.sources import csv_rows
from tallymart.sources.star import Star
from tests.conftest import PRODUCTS, RAW, STORES


def folder(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    return str(tmp_path)


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 500)
    spark.conf.set("spark.sql.files.openCostInBytes", 100)
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


HEADER = "store_id,store_name,category,district\n"


def test_row_numbers_over_files_and_splits(spark, tmp_path, small_splits):
    texts, expected, k = {}, [], 0
    for name, rows in (("b", 120), ("a", 300), ("c", 0), ("d", 1)):
        texts[name] = HEADER + "".join(f"S{name}{i},n{i},c,d\n" for i in range(rows))
    for name in "abcd":
        for line in texts[name].splitlines()[1:]:
            k += 1
            expected.append((k, line.split(",")[0]))
    rows = csv_rows.read_rows(spark, folder(tmp_path, **texts), schema.RAW_STORES)
    assert rows.rdd.getNumPartitions() > 4
    got = csv_rows.numbered(csv_rows.well_formed(rows)).select("source_row", "store_id").collect()
    assert sorted(map(tuple, got)) == expected


def test_the_first_row_of_the_files_stays(spark, tmp_path, small_splits):
    text = HEADER + "S1,zeta,x,y\n s1 ,alpha,x,y\n" + "".join(f"S{i},m,x,y\n" for i in range(2, 200)) + "s150,a,x,y\n"
    later = HEADER + "S1,aaa,x,y\nS500,new,x,y\ns500,Anew,x,y\n"
    rows = csv_rows.well_formed(csv_rows.read_rows(spark, folder(tmp_path, a=text, b=later), schema.RAW_STORES))
    names = {r["store_id"]: r["store_name"] for r in clean.clean_stores(rows, csv_rows.SOURCE).collect()}
    assert (names["S1"], names["S150"], names["S500"], len(names)) == ("zeta", "m", "new", 200)


def test_first_product_price_counts_even_if_unreadable(spark, tmp_path):
    text = "product_id,product_name,product_category,unit_price\np1,a,c,bad\nP1,a,c,3\nP2,b,c,4\n"
    rows = csv_rows.well_formed(csv_rows.read_rows(spark, folder(tmp_path, a=text), schema.RAW_PRODUCTS))
    assert {tuple(r) for r in clean.clean_products(rows, csv_rows.SOURCE).collect()} == {("P1", "a", "c", None), ("P2", "b", "c", 4.0)}


DIRTY = (
    "\ufeffextra,district,store_id,store_name,category\n"
    'x,North,S1,"Soup, ""hot""",a\n'
    "x,North,S2,Poke\n"
    "x,North,S3,Bao,a,more\n"
    'x,North,S4,"a,b",c,d\n'
    'x,"No,rth",S5\n'
    "x,North,S2,Poke\n"
    "\n"
    ",n/a,S6,,NULL\n"
)


def test_malformed_rows_are_kept_apart(spark, tmp_path):
    rows = csv_rows.read_rows(spark, folder(tmp_path, a=DIRTY), schema.RAW_STORES)
    good = csv_rows.well_formed(rows)
    assert good.columns == [*schema.STORE_COLUMNS, csv_rows.SOURCE]
    assert {tuple(r)[:4] for r in good.collect()} == {("S1", 'Soup, "hot"', "a", "North"), ("S6", None, None, None)}
    assert {tuple(r) for r in csv_rows.malformed(rows).collect()} == {
        ("x,North,S2,Poke", "missing_cells", 2), ("x,North,S3,Bao,a,more", "surplus_cells", 1),
        ('x,North,S4,"a,b",c,d', "surplus_cells", 1), ('x,"No,rth",S5', "missing_cells", 1),
    }
    counts = {r["metric"]: r["value"] for r in audit.malformed_rows(rows, "stores").collect()}
    assert counts == {"surplus_cells": "2", "missing_cells": "3", "unreadable": "0"}
    assert rows.where(F.col(csv_rows.MALFORMED).isNotNull()).count() == 5
    with pytest.raises(ValueError, match="malformed rows"):
        csv_rows.read_rows(spark, str(tmp_path), schema.RAW_STORES, strict=True)


def test_strict_takes_a_table_that_fits(spark, tmp_path):
    path = folder(tmp_path, a=HEADER + "S1,a,b,c\n")
    assert csv_rows.read_rows(spark, path, schema.RAW_STORES, strict=True).count() == 1


def test_empty_file(spark, tmp_path):
    rows = csv_rows.read_rows(spark, folder(tmp_path, a=HEADER), schema.RAW_STORES)
    assert csv_rows.well_formed(rows).collect() == [] and csv_rows.malformed(rows).collect() == []
    assert csv_rows.numbered(csv_rows.well_formed(rows)).collect() == []


def test_batch_from_files(spark, tmp_path, raw):
    """Three files through reading, cleaning and judging, with a malformed line that stays out of the star."""
    def csv(columns, rows, more=""):
        return "\n".join([",".join(columns), *(",".join('"' + (c or "") + '"' for c in r) for r in rows)]) + "\n" + more

    for name, columns, rows in (("sales", schema.SALES_COLUMNS, RAW), ("stores", schema.STORE_COLUMNS, STORES), ("products", schema.PRODUCT_COLUMNS, PRODUCTS)):
        (tmp_path / f"{name}.csv").write_text(csv(columns, rows, "a,b\n" if name == "sales" else ""), encoding="utf-8")
    paths = [str(tmp_path / f"{name}.csv") for name in ("sales", "stores", "products")]
    good, bad = batch.read_source(spark, *paths)
    assert [tuple(r) for r in bad.sales.collect()] == [("a,b", "missing_cells", 1)]
    star = batch.clean_source(good)
    plain = batch.clean_star(raw)
    for name in ("sales", "stores", "products"):
        assert sorted(map(str, getattr(star, name).collect())) == sorted(map(str, getattr(plain, name).collect()))
    with pytest.raises(ValueError, match="missing_cells"):
        batch.read_source(spark, *paths, strict=True)


def test_one_judged_write(spark, raw, tmp_path):
    made = batch.judge_once(raw, str(tmp_path / "judged"))
    assert sorted(map(str, made.sales.drop("month").collect())) == sorted(map(str, clean.clean_sales(raw.sales, raw.stores, raw.products).collect()))
    assert {r["month"] for r in made.sales.collect()} == {"2026-05", "2026-07"}
    assert sorted(map(str, made.rejects.collect())) == sorted(map(str, clean.rejects(raw.sales, raw.stores, raw.products).collect()))
    assert [tuple(r) for r in made.funnel.collect()] == [tuple(r) for r in clean.funnel(raw.sales, raw.stores, raw.products).collect()]


def test_one_judged_write_of_nothing(spark, raw, tmp_path):
    empty = Star(raw.sales.limit(0), raw.stores, raw.products)
    made = batch.judge_once(empty, str(tmp_path / "judged"))
    assert made.sales.count() == 0 and {r["row_count"] for r in made.funnel.collect()} == {0}


def test_the_raw_table_is_read_once(spark, raw, tmp_path):
    path = str(tmp_path / "raw")
    raw.sales.write.parquet(path)
    stored = Star(spark.read.parquet(path), raw.stores, raw.products)
    plan = batch.observed(stored, Observation())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and "CollectMetrics" in plan
