"""The way taken when no side is small enough to broadcast gives the same rows."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest

from tallymart.functions import sizes
from tallymart.operators import clean, dashboard, facts
from tallymart.plans import batch
from tallymart.sources.star import Star
from tests.conftest import CLEAN, sales_of, values_of
from tests.test_clean import FUNNEL, by_text


@pytest.fixture
def nothing_small(spark, monkeypatch):
    monkeypatch.setattr(sizes, "measured_bytes", lambda df: sizes.BROADCAST_BYTES + 1)
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    yield
    spark.conf.set(setting, before)


def test_cleaning(raw, nothing_small):
    assert by_text(values_of(batch.clean_star(raw).sales)) == by_text(CLEAN)
    assert dict(values_of(clean.funnel(raw.sales, raw.stores, raw.products))) == FUNNEL


def test_queries_with_one_hot_order_and_product(spark, star, nothing_small):
    hot = [("HOT", date(2026, 5, 2), "S01", "P01", 1, Decimal("0.01"), "card")] * 3000
    rest = [(f"O{i}", date(2026, 5, 2), "S02", "P20", 2, Decimal("1.00"), None) for i in range(300)]
    busy = Star(sales_of(spark, hot + rest), star.stores, star.products)
    assert values_of(facts.product_rank(busy, category="饮品", limit=9)) == [
        ("P20", "梅子酒", "饮料", 300.0, 600, 300)
    ]
    assert values_of(facts.category_rank(busy, limit=9)) == [("饮料", 300.0, 600, 300), ("主食", 30.0, 3000, 1)]
    assert values_of(facts.store_revenue(busy, "soup")) == [("S01", "Corner Soup", 30.0, 3000, 1)]
    assert values_of(dashboard.category_share(busy)) == [("饮料", 300.0, 90.9), ("主食", 30.0, 9.1)]
    assert values_of(dashboard.kpi_summary(busy)) == [(330.0, 301, 1.1, 301)]
