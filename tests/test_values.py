from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallymart.functions import bounds, metrics, sizes, values


def each(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("t"))).collect()]


def test_dates(spark):
    texts = [
        "2026-05-01", "2026/05/01", "2026.05.01", "24-07-2026", "24/07/2026", "24.07.2026",
        " 2026-5-1　", "2026-05/01", "2026-02-30", "26-05-01", "20260-05-01", "0000-01-01",
        "2026", "2026-05", "", None, "2026-05-01x", "1-1-0000", "2026-05-01\n2026-05-02",
    ]
    july = date(2026, 7, 24)
    may = date(2026, 5, 1)
    assert each(spark, texts, values.parse_date) == [may] * 3 + [july] * 3 + [may] + [None] * 12


def test_dates_year_first(spark):
    texts = ["2026-05/01", "2026.5.1", "01-05-2026", "n/a", None]
    parsed = each(spark, texts, values.parse_date_year_first)
    assert parsed == [date(2026, 5, 1)] * 2 + [None] * 3


def test_numbers(spark):
    texts = ["12", " 12 ", "1e3", ".5", "5.", "+7", "-3", "12d", "1_000", "inf", "NaN", "", "1 2", None]
    assert each(spark, texts, values.number) == [
        12.0, 12.0, 1000.0, 0.5, 5.0, 7.0, -3.0, *[None] * 7,
    ]


def test_money(spark):
    texts = ["¥1,038.50", " ￥ 66 ", "1.005", "-4", "bad", "1e30", "¥", None]
    assert each(spark, texts, values.money) == [
        Decimal("1038.50"), Decimal("66.00"), Decimal("1.01"), Decimal("-4.00"), *[None] * 4,
    ]


def test_ids(spark):
    assert each(spark, ["　 s01\x1c", "", None], values.normalize_id) == ["S01", "", None]


def test_loose_bounds():
    assert bounds.loose_day("2026-05-01 10:00") == date(2026, 5, 1)
    assert bounds.loose_day("20260501") == date(2026, 5, 1)
    assert bounds.loose_day("01/02/2026") == date(2026, 1, 2)
    assert bounds.loose_day("2026/05/01 08:30") == date(2026, 5, 1)
    assert bounds.loose_day("2026-05-01T08:30:00.5+02:00") == date(2026, 5, 1)
    assert bounds.loose_day(" May 1, 2026 ") == date(2026, 5, 1)
    assert bounds.loose_day("nonsense") is None
    assert bounds.loose_day("") is None
    assert bounds.loose_day(None) is None


def test_strict_bounds():
    assert bounds.strict_day("2026-05-01", "start_date") == date(2026, 5, 1)
    assert bounds.strict_day("", "start_date") is None
    with pytest.raises(ValueError, match="Invalid start_date: 2026/07/24"):
        bounds.strict_day("2026/07/24", "start_date")


@pytest.mark.parametrize(
    ("given", "limit"), [(0, 1), (101, 100), (None, 1), ("3", 3), ("x", 1), (50, 50), ([], 1)]
)
def test_tool_limit(given, limit):
    assert bounds.tool_limit(given) == limit


def test_average_is_exact_half_up(spark):
    rows = [(Decimal("0.05"), 2), (Decimal("10.00"), 3), (Decimal("-34.0637"), 2), (Decimal("1"), 0)]
    df = spark.createDataFrame(rows, "_total decimal(28,4), order_count bigint")
    got = [r[0] for r in df.select(metrics.as_average()).collect()]
    assert got == [0.03, 3.33, -17.03, None]


def test_average_beyond_long(spark):
    rows = [(Decimal("12345678901234567890123.45"), 1_000_000_000_000)]
    df = spark.createDataFrame(rows, "_total decimal(28,2), order_count bigint")
    assert df.select(metrics.as_average()).first()[0] == 12345678901.23


def test_broadcast_is_measured(spark):
    df = spark.range(1000).withColumn("name", F.lit("x" * 100))
    assert sizes.measured_bytes(df) == 1000 * (16 + 16 + 100)
    assert sizes.measured_bytes(df.limit(0)) == 0
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    other = spark.range(10)
    assert "rightHint=(strategy=broadcast)" in plan(other.join(sizes.broadcast_if_small(df), "id"))
    assert "broadcast" not in plan(other.join(sizes.broadcast_if_small(df, 1000), "id"))
