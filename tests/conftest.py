from __future__ import annotations

import sys
from datetime import date
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tallymart import schema
from tallymart.sources.star import Star

CLEAN = [
    ("O1", date(2026, 5, 1), "S01", "P01", 2, Decimal("64.00"), "card"),
    ("O2", date(2026, 7, 24), "S02", "P04", 1, Decimal("1038.50"), "cash"),
    ("O10", date(2026, 7, 31), "S05", "P20", 3, Decimal("66.00"), None),
    ("O2", date(2026, 7, 24), "S01", "P15", 2, Decimal("12.00"), "cash"),
]

RAW = [
    ("O1", "2026-05-01", "S01", "P01", "2", "64.00", "card"),
    ("O1", "2026-05-01", "S01", "P01", "2", "64.00", "card"),
    (" o1", "2026/05/01", "s01", "p01", "2", "¥64.00", "card"),
    ("O2", "24-07-2026", "S02", "P04", "1", "1,038.50", "cash"),
    ("O3", "2026-13-01", "S02", "P05", "1", "34", "cash"),
    ("O4", "2026-05-02", "S02", "P05", "0", "34", "cash"),
    ("O5", "2026-05-02", "S02", "P05", "x", "34", "cash"),
    ("O6", "2026-05-02", "S02", "P05", "1", None, "cash"),
    ("O7", "2026-05-02", "S02", "P05", "1", "-34", "cash"),
    ("O8", "2026-05-02", "S99", "P05", "1", "34", "cash"),
    ("O9", "2026-05-02", "S02", "P99", "1", "34", "cash"),
    ("O10", "31.07.2026", "S05", "P20", "3", "￥66", None),
    ("O11", "2026-05-02", "S99", "P99", "0", "bad", "cash"),
    ("O2", "2026-07-24", "S01", "P15", "2", "12", "cash"),
]

STORES = [
    ("S01", "Corner Soup", "拉面", "North"),
    ("S02", "Harbour Poke", "轻食", "East"),
    ("S03", "Bao House", "点心", "South"),
    ("S04", "Sando Bar", "三明治", "West"),
    ("S05", "Night Grill", "日料", "Centre"),
]

PRODUCTS = [
    ("P01", "豚骨拉面", "主食", "32.0"),
    ("P02", "味增拉面", "主食", "30.0"),
    ("P04", "三文鱼poke", "主食", "38.0"),
    ("P05", "鸡肉poke", "主食", "34.0"),
    ("P06", "牛肉poke", "主食", "42.0"),
    ("P07", "小笼包", "点心", "22.0"),
    ("P13", "炸鸡块", "小食", "20.0"),
    ("P15", "绿茶", "饮料", "6.0"),
    ("P20", "梅子酒", "饮料", "22.0"),
]


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw(spark):
    return Star(
        spark.createDataFrame(RAW, schema.RAW_SALES),
        spark.createDataFrame(STORES, schema.RAW_STORES),
        spark.createDataFrame(PRODUCTS, schema.RAW_PRODUCTS),
    )


@pytest.fixture(scope="session")
def star(spark):
    products = [(i, n, c, float(p)) for i, n, c, p in PRODUCTS]
    return Star(
        spark.createDataFrame(CLEAN, schema.SALES),
        spark.createDataFrame(STORES, schema.STORES),
        spark.createDataFrame(products, schema.PRODUCTS),
    )


def sales_of(spark, rows):
    return spark.createDataFrame(rows, schema.SALES)


def values_of(df):
    return [tuple(row) for row in df.collect()]
