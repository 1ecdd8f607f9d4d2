"""Checks on a loaded star: row counts, references and table constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.sources.star import Star

REQUIRED = {
    "sales": ["order_id", "date", "store_id", "product_id", "qty", "amount"],
    "stores": ["store_name"],
    "products": ["product_name"],
}
PRIMARY_KEYS = {"stores": "store_id", "products": "product_id"}


def row_counts(star: Star) -> DataFrame:
    """Rows per table."""
    counts = [
        table.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, table in star.tables().items()
    ]
    return reduce(DataFrame.unionAll, counts)


def _orphans(star: Star, dimension: str, key: str, keep_null: bool = True) -> DataFrame:
    """Sales rows whose key is not in the dimension, as one count.

    Sales are counted per pair of keys first. Both references start from that grouping, whose
    exchange they share, and the join sees one row per key, however many rows a key holds.
    """
    pairs = star.sales.groupBy(*PRIMARY_KEYS.values()).agg(F.count(F.lit(1)).alias("n"))
    per_key = pairs.groupBy(key).agg(F.sum("n").alias("n"))
    missing = per_key.join(star.tables()[dimension].select(key), key, "left_anti")
    # Null keys are left out here: a filter would sink below the grouping and part the exchanges.
    counted = F.col("n") if keep_null else F.when(F.col(key).isNotNull(), F.col("n"))
    return missing.agg(F.coalesce(F.sum(counted), F.lit(0)).cast("bigint").alias("n"))


def orphans(star: Star) -> DataFrame:
    """Per reference: sales rows without a partner; a null key has none."""
    checks = [
        _orphans(star, dimension, key).select(
            F.lit(dimension).alias("dimension"), F.col("n").alias("orphan_rows")
        )
        for dimension, key in PRIMARY_KEYS.items()
    ]
    return reduce(DataFrame.unionAll, checks)


def null_counts(table: str) -> list[Column]:
    """Null cells of each required column of a table, named like the column."""
    return [F.count_if(F.col(c).isNull()).alias(c) for c in REQUIRED[table]]


def constraints(star: Star, sales_nulls: dict[str, int] | None = None) -> DataFrame:
    """Violations per rule: required cells, unique keys and references.

    Rows counted: null cells; rows beyond the first of each repeated key; rows with an unknown
    (not null) reference. ``sales_nulls`` gives the ``null_counts`` of the fact where its write has counted
    them; the fact is then read for its references only.
    """
    found = []
    for name, columns in REQUIRED.items():
        if name == "sales" and sales_nulls is not None:
            known = [F.lit(sales_nulls[c]).cast("bigint").alias(c) for c in columns]
            nulls = star.sales.sparkSession.range(1).select(*known)
        else:
            nulls = star.tables()[name].agg(*null_counts(name))
        found.append(
            nulls.unpivot([], columns, "column_name", "violations").select(
                F.lit(name).alias("table_name"),
                F.lit("not_null").alias("rule"),
                "column_name",
                "violations",
            )
        )
    for name, key in PRIMARY_KEYS.items():
        per_key = (
            star.tables()[name].where(F.col(key).isNotNull())
            .groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        )
        found.append(_violations(per_key.agg(F.sum(F.col("n") - 1).alias("n")), name, "unique", key))
    for name, key in PRIMARY_KEYS.items():
        unknown = _orphans(star, name, key, keep_null=False)
        found.append(_violations(unknown, "sales", "reference", key))
    return reduce(DataFrame.unionAll, found)


def _violations(count: DataFrame, table: str, rule: str, column: str) -> DataFrame:
    return count.select(
        F.lit(table).alias("table_name"),
        F.lit(rule).alias("rule"),
        F.lit(column).alias("column_name"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("violations"),
    )


def require_valid(star: Star, sales_nulls: dict[str, int] | None = None) -> None:
    """Raise when any constraint is broken. The report has one row per rule."""
    broken = constraints(star, sales_nulls).where("violations > 0").collect()
    if broken:
        rules = ", ".join(
            f"{r['table_name']}.{r['column_name']} {r['rule']}: {r['violations']}" for r in broken
        )
        raise ValueError(f"constraints violated: {rules}")
