"""From raw text tables to typed tables, and an account of every row left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.functions import values
from tallymart.functions.sizes import broadcast_if_small
from tallymart.schema import MONEY, SALES_COLUMNS

COPIES = "copies"
DISTINCT = "distinct_rows"
REASON = "reject_reason"

# Stages of the funnel in the order in which a row meets them.
RULES = ["invalid_date", "invalid_qty", "invalid_amount", "invalid_store", "invalid_product"]
STAGES = ["in", "raw_duplicates", *RULES, "final_duplicates", "out"]


def dedup(df: DataFrame) -> DataFrame:
    """Rows equal in every column once. Equal rows meet on the map side before the shuffle."""
    return df.dropDuplicates()


def clean_stores(raw: DataFrame, order: str | None = None) -> DataFrame:
    """Ids normalised; the first row per id is kept."""
    ids = raw.withColumn("store_id", values.normalize_id(F.col("store_id")))
    return _first_per_key(ids, "store_id", order)


def clean_products(raw: DataFrame, order: str | None = None) -> DataFrame:
    """As stores, and the price becomes a number or null."""
    typed = raw.withColumn(
        "product_id", values.normalize_id(F.col("product_id"))
    ).withColumn("unit_price", values.number(F.col("unit_price").cast("string")))
    return _first_per_key(typed, "product_id", order)


def _first_per_key(df: DataFrame, key: str, order: str | None) -> DataFrame:
    # "First" is by the column that numbers the rows if there is one, otherwise by content.
    # The rank filter lets Spark cut each map task's output to one row per key.
    sort = [order] if order else [c for c in df.columns if c != key]
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*sort))
    first = df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return first.drop(order) if order else first


def _normalized(raw: DataFrame, keep: list[str]) -> DataFrame:
    """Cleaned cells beside what the rules still need: the quantity before truncation and the
    amount before rounding."""
    cells = values.computed_once(
        raw,
        {
            "order_id": values.normalize_id(F.col("order_id")),
            "date": values.parse_date(F.col("date")),
            "store_id": values.normalize_id(F.col("store_id")),
            "product_id": values.normalize_id(F.col("product_id")),
            "_qty": values.number(F.col("qty")),
            "_amount": values.number_text(values.money_text(F.col("amount"))),
        },
        [F.col(c) for c in keep],
    )
    return cells.select(
        *keep,
        "order_id",
        "date",
        "store_id",
        "product_id",
        F.col("_qty").try_cast("bigint").alias("qty"),
        F.col("_amount").try_cast(MONEY).alias("amount"),
        "_qty",
        F.col("_amount").try_cast("double").alias("_amount"),
    )


def _valid_cells() -> dict[str, Column]:
    """What a row must satisfy on its own. Numbers too large for their type are invalid."""
    return {
        "invalid_date": F.col("date").isNotNull(),
        "invalid_qty": (F.col("_qty") > 0) & F.col("qty").isNotNull(),
        "invalid_amount": (F.col("_amount") > 0) & F.col("amount").isNotNull(),
    }


def _known(dimension: DataFrame, key: str) -> DataFrame:
    ids = dimension.select(values.normalize_id(F.col(key)).alias(key))
    return broadcast_if_small(ids.where(F.col(key).isNotNull()))


def keep_known(sales: DataFrame, stores: DataFrame, products: DataFrame) -> DataFrame:
    """Rows whose store and product both exist; a null id exists nowhere."""
    return sales.join(_known(stores, "store_id"), "store_id", "left_semi").join(
        _known(products, "product_id"), "product_id", "left_semi"
    )


def clean_sales(raw: DataFrame, stores: DataFrame, products: DataFrame) -> DataFrame:
    """Valid rows, typed, each once.

    One shuffle: removing raw copies first would not change the outcome, because equal raw rows
    stay equal, so the only dedup is the final one.
    """
    valid = reduce(lambda a, b: a & b, _valid_cells().values())
    rows = _normalized(raw, ["payment"]).where(valid)
    return keep_known(rows, stores, products).select(*SALES_COLUMNS).dropDuplicates()


def judge(raw: DataFrame, stores: DataFrame, products: DataFrame) -> DataFrame:
    """Every distinct raw row with its cleaned cells, its number of copies and the first rule
    it breaks (null if none). Raw cells are kept under ``raw_`` names."""
    distinct = raw.groupBy(*SALES_COLUMNS).agg(F.count(F.lit(1)).alias(COPIES))
    raw_cells = {f"raw_{c}": F.col(c) for c in SALES_COLUMNS}
    rows = _normalized(distinct.withColumns(raw_cells), ["payment", COPIES, *raw_cells])

    def flagged(dimension: DataFrame, key: str, flag: str) -> DataFrame:
        return broadcast_if_small(
            dimension.select(values.normalize_id(F.col(key)).alias(key))
            .where(F.col(key).isNotNull())
            .distinct()
            .withColumn(flag, F.lit(True))
        )

    rows = rows.join(flagged(stores, "store_id", "_store"), "store_id", "left").join(
        flagged(products, "product_id", "_product"), "product_id", "left"
    )
    checks = {
        **_valid_cells(),
        "invalid_store": F.col("_store"),
        "invalid_product": F.col("_product"),
    }
    reason = F.coalesce(
        *[F.when(~F.coalesce(checks[rule], F.lit(False)), rule) for rule in RULES]
    )
    return rows.withColumn(REASON, reason)


def folded(judged: DataFrame) -> DataFrame:
    """Judged rows as they are stored: kept rows once by their cleaned cells, rejected ones by their raw cells.

    Adds how many distinct raw rows and how many raw rows each stands for.
    """
    kept = F.col(REASON).isNull()
    cells = [F.when(kept, F.col(c)).alias(c) for c in SALES_COLUMNS]
    raw = [F.when(~kept, F.col(f"raw_{c}")).alias(f"raw_{c}") for c in SALES_COLUMNS]
    return (
        judged.select(REASON, *cells, *raw, COPIES)
        .groupBy(REASON, *SALES_COLUMNS, *[f"raw_{c}" for c in SALES_COLUMNS])
        .agg(F.count(F.lit(1)).alias(DISTINCT), F.sum(COPIES).alias(COPIES))
    )


def funnel_metrics() -> list[Column]:
    """The funnel's stages as aggregates over folded rows."""
    kept = F.col(REASON).isNull()
    counted = {
        "in": F.sum(COPIES),
        "raw_duplicates": F.sum(F.col(COPIES) - F.col(DISTINCT)),
        **{rule: F.sum(F.when(F.col(REASON) == rule, F.col(DISTINCT))) for rule in RULES},
        "final_duplicates": F.sum(F.when(kept, F.col(DISTINCT) - 1)),
        "out": F.count_if(kept),
    }
    return [F.coalesce(counted[s], F.lit(0)).cast("bigint").alias(s) for s in STAGES]


def rejects(raw: DataFrame, stores: DataFrame, products: DataFrame) -> DataFrame:
    """Rows that break a rule, as they came, with the reason and their number of copies."""
    return (
        judge(raw, stores, products)
        .where(F.col(REASON).isNotNull())
        .select(*[F.col(f"raw_{c}").alias(c) for c in SALES_COLUMNS], COPIES, REASON)
    )


def funnel(raw: DataFrame, stores: DataFrame, products: DataFrame) -> DataFrame:
    """Rows per cleaning stage. Each stage counts only rows that passed the ones before.

    Three aggregates of falling size: raw rows, kept rows by cleaned cells (rejected rows fold
    into one group per reason on the map side), then one row per reason.
    """
    kept = F.col(REASON).isNull()
    cells = [F.when(kept, F.col(c)).alias(c) for c in SALES_COLUMNS]
    per_row = (
        judge(raw, stores, products)
        .select(REASON, *cells, COPIES)
        .groupBy(REASON, *SALES_COLUMNS)
        .agg(F.count(F.lit(1)).alias("distinct_rows"), F.sum(COPIES).alias(COPIES))
    )
    per_reason = per_row.groupBy(REASON).agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("distinct_rows").alias("distinct_rows"),
        F.sum(COPIES).alias(COPIES),
    )
    counted = {
        "in": F.sum(COPIES),
        "raw_duplicates": F.sum(F.col(COPIES) - F.col("distinct_rows")),
        **{
            rule: F.sum(F.when(F.col(REASON) == rule, F.col("distinct_rows")))
            for rule in RULES
        },
        "final_duplicates": F.sum(F.when(kept, F.col("distinct_rows") - F.col("groups"))),
        "out": F.sum(F.when(kept, F.col("groups"))),
    }
    totals = per_reason.agg(
        *[F.coalesce(counted[s], F.lit(0)).cast("bigint").alias(s) for s in STAGES]
    )
    return totals.unpivot([], STAGES, "stage", "row_count")
