"""The star schema: one sales fact with a store and a product dimension."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Star:
    """``sales.store_id`` refers to ``stores``, ``sales.product_id`` to ``products``."""

    sales: DataFrame
    stores: DataFrame
    products: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"sales": self.sales, "stores": self.stores, "products": self.products}

    def register(self) -> list[str]:
        """Make the three tables visible to SQL under their own names."""
        for name, table in self.tables().items():
            table.createOrReplaceTempView(name)
        return list(self.tables())
