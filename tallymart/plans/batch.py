"""The batch job: audit, clean and load."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymart import schema
from tallymart.operators import audit, clean, document
from tallymart.session import stored
from tallymart.sources import csv_rows
from tallymart.sources.files import read_raw_csv
from tallymart.sources.star import Star

OUTCOME = "outcome"


def read_raw(spark: SparkSession, sales: str, stores: str, products: str) -> Star:
    """The three raw CSV tables as text."""
    return Star(
        read_raw_csv(spark, sales, schema.RAW_SALES),
        read_raw_csv(spark, stores, schema.RAW_STORES),
        read_raw_csv(spark, products, schema.RAW_PRODUCTS),
    )


def clean_star(raw: Star) -> Star:
    """All three tables cleaned.

    Sales are checked against the raw dimensions: ids are normalised on both sides, so these
    hold the same ids as the cleaned ones, without waiting for their dedup.
    """
    return Star(
        clean.clean_sales(raw.sales, raw.stores, raw.products),
        clean.clean_stores(raw.stores),
        clean.clean_products(raw.products),
    )


@dataclass(frozen=True)
class Judged:
    """What one pass over the raw sales leaves: the cleaned ones (with their month), the rejects and the funnel."""

    sales: DataFrame
    rejects: DataFrame
    funnel: DataFrame


def observed(raw: Star, watch: Observation) -> DataFrame:
    """The rows of one judged write, with the funnel observed behind the last shuffle.

    There a task's rows count once: only finished tasks of the writing stage report.
    """
    judged = clean.folded(clean.judge(raw.sales, raw.stores, raw.products))
    kept = F.col(clean.REASON).isNull()
    placed = judged.withColumns({
        OUTCOME: F.when(kept, "sales").otherwise("rejects"),
        "month": F.when(kept, F.date_format("date", "yyyy-MM")).otherwise("none"),
    })
    return placed.hint("rebalance", F.col(OUTCOME), F.col("month")).observe(watch, *clean.funnel_metrics())


def judge_once(raw: Star, folder: str) -> Judged:
    """Clean sales, rejects and funnel out of one read and one judgement of the raw sales.

    All rows are written to a new ``folder`` by outcome and month; the funnel is what the write observed.
    """
    spark = raw.sales.sparkSession
    watch = Observation()
    rows = observed(raw, watch)
    rows.write.partitionBy(OUTCOME, "month").parquet(folder)
    # Folder names are texts, whatever they look like.
    kinds = T.StructType([T.StructField(f.name, T.StringType() if f.name in (OUTCOME, "month") else f.dataType) for f in rows.schema])
    stored = spark.read.schema(kinds).parquet(folder)
    raw_cells = [F.col(f"raw_{c}").alias(c) for c in schema.SALES_COLUMNS]
    counted = watch.get
    return Judged(
        sales=stored.where(F.col(OUTCOME) == "sales").select(*schema.SALES_COLUMNS, "month"),
        rejects=stored.where(F.col(OUTCOME) == "rejects").select(*raw_cells, clean.COPIES, clean.REASON),
        funnel=spark.createDataFrame([(s, counted[s]) for s in clean.STAGES], "stage string, row_count bigint"),
    )


def read_source(spark: SparkSession, sales: str, stores: str, products: str, strict: bool = False) -> tuple[Star, Star]:
    """The three raw CSV tables: (rows that fit their header, with their places; malformed rows).

    ``strict`` raises where a row does not fit.
    """
    found = [
        csv_rows.read_rows(spark, path, kinds, strict=strict)
        for path, kinds in ((sales, schema.RAW_SALES), (stores, schema.RAW_STORES), (products, schema.RAW_PRODUCTS))
    ]
    good = [csv_rows.well_formed(t) for t in found]
    return Star(good[0].drop(csv_rows.SOURCE), good[1], good[2]), Star(*[csv_rows.malformed(t) for t in found])


def clean_source(raw: Star) -> Star:
    """As ``clean_star`` for tables of ``read_source``: of rows with one id the first in the file stays."""
    return Star(
        clean.clean_sales(raw.sales, raw.stores, raw.products),
        clean.clean_stores(raw.stores, csv_rows.SOURCE),
        clean.clean_products(raw.products, csv_rows.SOURCE),
    )


def audit_report(raw: Star) -> DataFrame:
    """The whole quality report of the three raw tables."""
    return (
        audit.audit_sales(raw.sales, raw.stores, raw.products)
        .unionByName(audit.audit_dimension(raw.stores, "stores", "store_id"))
        .unionByName(audit.audit_dimension(raw.products, "products", "product_id"))
    )


def audit_document(raw: Star) -> DataFrame:
    """The report as one nested row. The metric rows are stored first: the document and its ranks both read them."""
    report = stored(audit_report(raw), "audit")
    return document.document(report, {name: table.columns for name, table in raw.tables().items()})


def write_report(report: DataFrame, path: str) -> None:
    """JSON lines, text kept as it is. The histogram part can be long, so it stays in parts."""
    report.write.mode("overwrite").json(path)
