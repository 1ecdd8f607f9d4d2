"""Every query by name: a function of (session, table folder) that returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart import schema
from tallymart.functions import values
from tallymart.functions.bounds import between_loose, between_strict
from tallymart.functions.dates import loose_date
from tallymart.functions.metrics import TOTAL, as_revenue
from tallymart.operators import (
    answers,
    audit,
    clean,
    dashboard,
    document,
    facts,
    numbering,
    questions,
    ranges,
    resolve,
    trend,
    verify,
)
from tallymart.plans import adhoc, batch
from tallymart.session import fresh_path, tune
from tallymart.sources import csv_rows, files, sample, tables
from tallymart.sources.star import Star

Query = Callable[[SparkSession, str], DataFrame]

START, END = "1996-03-01", "1999-10-31"
QUESTION_WORDS = {
    "beverage_words": ["the", "der"],
    "ranking_words": ["ing", "ung"],
    "product_phrases": ["tion de", "ción de"],
    "aov_words": ["que", "mente"],
    "beverage_category": "PROMO",
}
FOLLOW_UP_WORDS = ["that", "nicht", "pour", "las"]
CATEGORY_SUFFIX = " goods"
CATEGORY_ALIASES = ["economy", "budget"]
ADHOC_SQL = """
    SELECT st.district, p.product_category, CAST(SUM(s.amount) AS DOUBLE) AS revenue,
           COUNT(DISTINCT s.order_id) AS order_count, 'no update here; none' AS note
    FROM sales s
    JOIN stores st ON s.store_id = st.store_id
    JOIN products p ON s.product_id = p.product_id
    GROUP BY st.district, p.product_category;
"""

# Arguments that the stand-in plans of ``question_answers`` draw from; dates as typed, and what they mean.
TOOLS = [
    "product_rank", "category_rank", "store_rank", "product_revenue", "product_quantity", "product_orders", "product_monthly_sales",
    "product_daily_sales", "category_revenue", "store_revenue", "daily_sales", "monthly_sales", "aov_trend", "dataset_summary", "other",
]
TYPED_PRODUCTS = ["Small Ring", "my red widget", "blue", "no such thing", None, "", "hot plate", "cold gizmo"]
TYPED_CATEGORIES = ["economy", "Promo", None, "large", "what", "STANDARD parts"]
TYPED_STORES = ["supplier#000000007", "at Supplier#000000012", None, "00003", "nowhere"]
TYPED_DATES = {
    "Mar 1996": "1996-03-01", "1 Jul 98": "1998-07-01", "1997": "1997-01-01", "some day": None, None: None, "1998-02-10 08:30 PM": "1998-02-10",
    "Friday, October 31, 1999": "1999-10-31", "06/15/00": "2000-06-15", "199811": None, "1999Q3": "1999-07-01",
}

_QUERIES: dict[str, Query] = {}


def _query(build: Query) -> Query:
    """Register a query under its function name, with the session settings applied."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(tune(spark), folder)

    run.__name__, run.__doc__ = build.__name__, build.__doc__
    _QUERIES[build.__name__] = run
    return run


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _raw(spark: SparkSession, folder: str) -> Star:
    return Star(
        sample.raw_sales(spark, folder),
        sample.raw_stores(spark, folder),
        sample.raw_products(spark, folder),
    )


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return sample.read(spark, folder, table)


# --- sources and sinks -------------------------------------------------------------------


@_query
def src_csv(spark, folder):
    """Raw sales written as CSV and read back as text."""
    path = fresh_path(spark, "raw-sales")
    files.write_csv(sample.raw_sales(spark, folder), path)
    return files.read_raw_csv(spark, path, schema.RAW_SALES)


@_query
def clean_roundtrip(spark, folder):
    """Cleaned sales written to the processed layer and read back."""
    path = fresh_path(spark, "processed")
    files.write_processed(batch.clean_star(_raw(spark, folder)), path)
    sales = files.read_processed(spark, path).sales
    return sales.withColumn("amount", F.col("amount").cast("double"))


@_query
def load_tables(spark, folder):
    """Full refresh with constraint checks; the loaded tables' columns and filled cells."""
    loaded = files.load(batch.clean_star(_raw(spark, folder)), fresh_path(spark, "loaded"))
    sales = loaded.sales.drop("month")
    return files.catalog(Star(sales, loaded.stores, loaded.products).tables())


def _in_files(df: DataFrame, key: Column) -> DataFrame:
    """The rows in four files, in the order of the key across them."""
    return df.withColumn("_key", key).repartitionByRange(4, "_key").sortWithinPartitions("_key").drop("_key")


@_query
def source_first_stores(spark, folder):
    """Stores under two spellings of each id, written to several files in hash order; the first in the files stays."""
    raw = sample.raw_stores(spark, folder)
    again = raw.select(
        F.concat(F.lit(" "), F.lower("store_id")).alias("store_id"), F.concat(F.lit("~"), "store_name").alias("store_name"), "category", "district"
    )
    path = fresh_path(spark, "stores")
    files.write_csv(_in_files(raw.unionByName(again), F.md5(F.concat("store_id", "store_name"))), path)
    return clean.clean_stores(csv_rows.well_formed(csv_rows.read_rows(spark, path, schema.RAW_STORES)), csv_rows.SOURCE)


@_query
def source_first_products(spark, folder):
    """As the stores, with the row number of the kept row."""
    raw = sample.raw_products(spark, folder)
    again = raw.withColumns({"product_id": F.lower("product_id"), "unit_price": F.lit("n/a")})
    path = fresh_path(spark, "products")
    files.write_csv(_in_files(raw.unionByName(again), F.md5(F.concat("product_id", "product_name"))), path)
    rows = csv_rows.numbered(csv_rows.well_formed(csv_rows.read_rows(spark, path, schema.RAW_PRODUCTS)))
    return clean.clean_products(rows.withColumn("place", F.col("source_row")), "place")


def _dirty_csv(spark, folder) -> str:
    """Raw sales as CSV lines without a header, some with a cell too many or too few by rule."""
    quoted = [F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"')) for c in schema.SALES_COLUMNS]
    line = F.concat_ws(",", *quoted)
    size = F.length(line)
    lines = sample.raw_sales(spark, folder).select(
        F.when(size % 50 == 7, F.concat(line, F.lit(',"x"'))).when(size % 50 == 8, F.concat_ws(",", *quoted[:5])).otherwise(line).alias("value")
    )
    path = fresh_path(spark, "dirty")
    lines.write.text(path)
    return path


@_query
def source_malformed(spark, folder):
    """The malformed lines of a dirty CSV, with their reason and number."""
    return csv_rows.malformed(csv_rows.read_rows(spark, _dirty_csv(spark, folder), schema.RAW_SALES, header=False))


@_query
def source_malformed_audit(spark, folder):
    """Malformed lines counted for the audit, beside the basic facts of the lines that fit."""
    rows = csv_rows.read_rows(spark, _dirty_csv(spark, folder), schema.RAW_SALES, header=False)
    good = csv_rows.well_formed(rows).drop(csv_rows.SOURCE)
    return audit.malformed_rows(rows, "sales").unionByName(audit.missing_values(good, "sales"))


def _judged(spark, folder) -> batch.Judged:
    return batch.judge_once(_raw(spark, folder), fresh_path(spark, "judged"))


@_query
def once_sales(spark, folder):
    """Cleaned sales out of the one judged write."""
    return _judged(spark, folder).sales.withColumn("amount", F.col("amount").cast("double"))


@_query
def once_rejects(spark, folder):
    """Rejected rows out of the one judged write."""
    return _judged(spark, folder).rejects


@_query
def once_funnel(spark, folder):
    """The funnel that the judged write observed."""
    return _judged(spark, folder).funnel


@_query
def catalog_tables(spark, folder):
    """The star loaded into tables of the catalog, and what the catalog lists of them."""
    database = f"tallymart_{uuid.uuid4().hex}"
    tables.create_database(spark, database, fresh_path(spark, "database"))
    tables.load_tables(batch.clean_star(_raw(spark, folder)), database)
    return tables.listing(spark, database).drop("comment")


def load_layer(spark, folder) -> str:
    """Raw tables cleaned, loaded and published below the path returned."""
    path = fresh_path(spark, "layer")
    files.load(batch.clean_star(_raw(spark, folder)), path)
    return path


#: Queries of a user over a published layer; the registered ones load it first.
ON_LAYER: dict[str, Callable[[Star], DataFrame]] = {
    "layer_category_rank": lambda star: facts.category_rank(star, limit=None),
    "layer_daily_sales": lambda star: facts.daily_sales(star, START, END),
    "layer_top_products": lambda star: dashboard.top_products(star, START, END, 50),
    "layer_store_sales": lambda star: dashboard.store_sales(star, START, END),
}


def _on_fresh_layer(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return ON_LAYER[name](files.read_published(spark, load_layer(spark, folder)))


@_query
def layer_category_rank(spark, folder):
    return _on_fresh_layer("layer_category_rank", spark, folder)


@_query
def layer_daily_sales(spark, folder):
    return _on_fresh_layer("layer_daily_sales", spark, folder)


@_query
def layer_top_products(spark, folder):
    return _on_fresh_layer("layer_top_products", spark, folder)


@_query
def layer_store_sales(spark, folder):
    return _on_fresh_layer("layer_store_sales", spark, folder)


@_query
def catalog_columns(spark, folder):
    return files.catalog(sample.star(spark, folder).tables())


# --- audit -------------------------------------------------------------------------------


@_query
def audit_basic(spark, folder):
    return audit.basic_info(sample.raw_sales(spark, folder), "sales")


@_query
def audit_missing(spark, folder):
    return audit.missing_values(sample.raw_sales(spark, folder), "sales")


@_query
def audit_dup_rows(spark, folder):
    return audit.duplicate_rows(sample.raw_sales(spark, folder), "sales")


@_query
def audit_pk_dups(spark, folder):
    """Rows of the fact that share an order id, as a key check would count them."""
    return audit.duplicate_keys(sample.raw_sales(spark, folder), "sales", "order_id")


@_query
def audit_order_id(spark, folder):
    return audit.order_ids(sample.raw_sales(spark, folder), "sales")


@_query
def audit_dates(spark, folder):
    return audit.dates(sample.raw_sales(spark, folder), "sales")


@_query
def audit_fk_store(spark, folder):
    raw = _raw(spark, folder)
    return audit.foreign_key(raw.sales, raw.stores, "sales", "store_id", "store_id")


@_query
def audit_fk_product(spark, folder):
    raw = _raw(spark, folder)
    return audit.foreign_key(raw.sales, raw.products, "sales", "product_id", "product_id")


@_query
def audit_qty(spark, folder):
    return audit.quantities(sample.raw_sales(spark, folder), "sales")


@_query
def audit_amount(spark, folder):
    return audit.amounts(sample.raw_sales(spark, folder), "sales")


@_query
def audit_dims(spark, folder):
    raw = _raw(spark, folder)
    return audit.audit_dimension(raw.stores, "stores", "store_id").unionByName(
        audit.audit_dimension(raw.products, "products", "product_id")
    )


@_query
def audit_report(spark, folder):
    """The whole report, written as JSON and read back."""
    path = fresh_path(spark, "audit")
    batch.write_report(batch.audit_report(_raw(spark, folder)), path)
    return spark.read.schema(schema.all_text(audit.REPORT)).json(path)


@_query
def audit_ranked_values(spark, folder):
    """Unknown references of the fact, the most frequent first."""
    return document.ranked_values(batch.audit_report(_raw(spark, folder)))


@_query
def audit_document(spark, folder):
    """Parts of the report's one document, written as JSON and read back."""
    raw = _raw(spark, folder)
    path = fresh_path(spark, "document")
    made = batch.audit_document(raw)
    made.write.json(path)
    read = spark.read.schema(made.schema).json(path)
    invalid = F.transform("sales.foreign_keys.store_id.invalid_values", lambda x: F.concat_ws(":", x["value"], x["row_count"]))
    return read.select(
        F.col("sales.basic_info.row_count").alias("sales_rows"),
        F.array_join("sales.basic_info.columns", ",").alias("sales_columns"),
        F.col("sales.basic_info.dtypes.qty").alias("qty_dtype"),
        F.col("sales.missing_values.amount.missing_rate").alias("amount_missing_rate"),
        F.col("sales.duplicate_rows").alias("duplicate_rows"),
        F.col("sales.order_id.duplicate_order_id_row_count").alias("order_rows"),
        F.col("sales.dates.date_format_separator_stats.`.`").alias("dotted_dates"),
        F.col("sales.dates.max_date").alias("max_date"),
        F.col("sales.foreign_keys.store_id.invalid_count").alias("unknown_stores"),
        F.array_join(F.slice(invalid, 1, 3), ",").alias("first_unknown_stores"),
        F.col("sales.amount.negative_count").alias("negative_amounts"),
        F.col("stores.primary_key.column").alias("stores_key"),
        F.col("products.primary_key.duplicate_count").alias("product_copies"),
    )


# --- cleaning ----------------------------------------------------------------------------


@_query
def clean_dedup(spark, folder):
    return clean.dedup(sample.raw_sales(spark, folder))


def _distinct_texts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("raw_value")).agg(F.count(F.lit(1)).alias("row_count"))


@_query
def clean_ids(spark, folder):
    texts = _distinct_texts(sample.raw_sales(spark, folder), "order_id")
    return texts.withColumn("clean_value", values.normalize_id(F.col("raw_value")))


@_query
def clean_dates(spark, folder):
    texts = _distinct_texts(sample.raw_sales(spark, folder), "date")
    return texts.withColumn("clean_value", values.parse_date(F.col("raw_value")))


@_query
def clean_amounts(spark, folder):
    texts = _distinct_texts(sample.raw_sales(spark, folder), "amount")
    return texts.withColumn("clean_value", values.money(F.col("raw_value")).cast("double"))


@_query
def clean_fk_semi(spark, folder):
    """Typed sales, all but those with an unknown store or product."""
    loose = sample.unchecked(spark, folder)
    kept = clean.keep_known(loose.sales, loose.stores, loose.products)
    return kept.select(*schema.SALES_COLUMNS).withColumn("amount", F.col("amount").cast("double"))


@_query
def clean_stores(spark, folder):
    """Suppliers, each also under its padded lower-case id and another name."""
    raw = sample.raw_stores(spark, folder)
    again = raw.select(
        F.concat(F.lit(" "), F.lower("store_id")).alias("store_id"),
        F.concat(F.lit("~"), "store_name").alias("store_name"),
        "category",
        "district",
    )
    return clean.clean_stores(raw.unionByName(again))


@_query
def clean_products(spark, folder):
    """Parts, each also under its lower-case id with an unreadable price."""
    raw = sample.raw_products(spark, folder)
    again = raw.select(
        F.lower("product_id").alias("product_id"),
        F.concat(F.lit("~"), "product_name").alias("product_name"),
        "product_category",
        F.lit("n/a").alias("unit_price"),
    )
    priceless = raw.select(
        F.concat(F.lit("N"), "product_id").alias("product_id"),
        "product_name",
        "product_category",
        F.lit("12d").alias("unit_price"),
    )
    return clean.clean_products(raw.unionByName(again).unionByName(priceless))


@_query
def sales_clean(spark, folder):
    sales = batch.clean_star(_raw(spark, folder)).sales
    return sales.withColumn("amount", F.col("amount").cast("double"))


@_query
def clean_funnel(spark, folder):
    raw = _raw(spark, folder)
    return clean.funnel(raw.sales, raw.stores, raw.products)


@_query
def clean_rejects(spark, folder):
    raw = _raw(spark, folder)
    return clean.rejects(raw.sales, raw.stores, raw.products)


# --- load verification -------------------------------------------------------------------


@_query
def verify_constraints(spark, folder):
    return verify.constraints(sample.unchecked(spark, folder))


@_query
def verify_counts(spark, folder):
    return verify.row_counts(batch.clean_star(_raw(spark, folder)))


@_query
def verify_orphans(spark, folder):
    return verify.orphans(sample.unchecked(spark, folder))


@_query
def surrogate_id(spark, folder):
    sales = sample.sales(spark, folder)
    order = ["date", "order_id", "store_id", "product_id", "qty", "amount", "payment"]
    numbered = numbering.number_rows(sales, order)
    return numbered.withColumn("amount", F.col("amount").cast("double"))


# --- filters -----------------------------------------------------------------------------


def _totals(sales: DataFrame) -> DataFrame:
    return sales.groupBy("date").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("qty").alias("qty")
    )


@_query
def filter_date_lenient(spark, folder):
    """A bound with a time of day, and one that cannot be read and is ignored."""
    return _totals(between_loose(sample.sales(spark, folder), "1998/02/10 08:30", "someday"))


@_query
def filter_date_strict(spark, folder):
    return _totals(between_strict(sample.sales(spark, folder), START, END))


@_query
def date_year_first(spark, folder):
    texts = _distinct_texts(sample.raw_sales(spark, folder), "date")
    return texts.withColumn("clean_value", values.parse_date_year_first(F.col("raw_value")))


# --- fact queries ------------------------------------------------------------------------


@_query
def product_rank(spark, folder):
    return facts.product_rank(
        sample.star(spark, folder), "desc", 20, "promo", start_date=START, end_date=END
    )


@_query
def product_revenue(spark, folder):
    return facts.product_revenue(sample.star(spark, folder), " Small RING ", START)


@_query
def product_quantity(spark, folder):
    return facts.product_quantity(
        sample.star(spark, folder), category="Eco", order="asc", limit=30, end_date=END
    )


@_query
def product_orders(spark, folder):
    return facts.product_orders(sample.star(spark, folder), "cold gizmo", START, END)


@_query
def product_monthly_sales(spark, folder):
    return facts.product_monthly_sales(sample.star(spark, folder), "hot plate, please")


@_query
def product_daily_sales(spark, folder):
    return facts.product_daily_sales(sample.star(spark, folder), "blue", START, END)


@_query
def category_rank(spark, folder):
    return facts.category_rank(sample.star(spark, folder), limit=None)


@_query
def category_revenue(spark, folder):
    return facts.category_revenue(sample.star(spark, folder), "large", START, END)


@_query
def store_rank(spark, folder):
    return facts.store_rank(sample.star(spark, folder), "asc", 25, START, END)


@_query
def store_revenue(spark, folder):
    return facts.store_revenue(sample.star(spark, folder), "supplier#000000007")


@_query
def daily_sales(spark, folder):
    return facts.daily_sales(sample.star(spark, folder))


@_query
def monthly_sales(spark, folder):
    return facts.monthly_sales(sample.star(spark, folder))


@_query
def aov_trend(spark, folder):
    return facts.aov_trend(sample.star(spark, folder), START, END)


@_query
def dataset_summary(spark, folder):
    return facts.dataset_summary(sample.star(spark, folder))


@_query
def category_performance(spark, folder):
    return facts.category_performance(sample.star(spark, folder))


@_query
def payment_sales(spark, folder):
    return facts.payment_sales(sample.star(spark, folder))


# --- dashboard ---------------------------------------------------------------------------


@_query
def dash_meta(spark, folder):
    """Over raw sales: dates that are not year-first do not count."""
    return dashboard.meta(_raw(spark, folder))


@_query
def dash_daily_sales(spark, folder):
    """Over unchecked sales: null dates drop, null amounts count as nothing."""
    return dashboard.daily_sales(sample.unchecked(spark, folder), START, END)


@_query
def dash_top_products(spark, folder):
    return dashboard.top_products(sample.star(spark, folder), START, END, 50)


@_query
def dash_store_sales(spark, folder):
    """Over unchecked sales: an unknown store keeps its row."""
    return dashboard.store_sales(sample.unchecked(spark, folder), START, END)


@_query
def dash_category_sales(spark, folder):
    """Over unchecked sales: unknown products fall under ``Unknown``."""
    return dashboard.category_sales(sample.unchecked(spark, folder))


@_query
def kpi_summary(spark, folder):
    return dashboard.kpi_summary(sample.star(spark, folder), START, END)


@_query
def category_share(spark, folder):
    return dashboard.category_share(sample.star(spark, folder), START, END)


@_query
def product_rank_position(spark, folder):
    return dashboard.ranked_products(sample.star(spark, folder), START, END, 100)


@_query
def display_labels(spark, folder):
    """Labels of every product sold, known or not."""
    loose = sample.unchecked(spark, folder)
    sold = dashboard.product_sales(loose)
    return dashboard.labelled(sold)


@_query
def format_money(spark, folder):
    """Each day's revenue as text."""
    daily = facts.daily_sales(sample.star(spark, folder))
    return daily.select("date", dashboard.format_money(F.col("revenue")).alias("revenue_text"))


# --- name resolution ---------------------------------------------------------------------


@_query
def resolve_product(spark, folder):
    """Names as typed: other case, shortened, lengthened, and brands that match nothing."""
    part = _read(spark, folder, "part")
    typed = F.explode(
        F.array(
            F.upper("p_name"),
            F.expr("substring(p_name, 1, length(p_name) - 2)"),
            F.expr("substring(p_name, 3, 4)"),
            F.concat(F.lit("  my "), "p_name", F.lit(" order ")),
            F.col("p_brand"),
            F.lit(""),
        )
    ).alias("typed")
    return resolve.resolve_names(part.select(typed), sample.products(spark, folder), "product_name")


@_query
def resolve_category(spark, folder):
    part = _read(spark, folder, "part")
    typed = F.explode(
        F.array(
            F.lower("p_type"),
            F.concat("p_type", F.lit(CATEGORY_SUFFIX)),
            F.regexp_replace("p_type", "ECONOMY", "Budget goods"),
            F.expr("substring(p_type, 1, 3)"),
            F.concat(F.lit("all "), "p_type", F.lit(" things")),
            F.col("p_brand"),
        )
    ).alias("typed")
    return resolve.resolve_categories(
        part.select(typed),
        sample.products(spark, folder),
        suffix=CATEGORY_SUFFIX,
        aliases=CATEGORY_ALIASES,
    )


@_query
def resolve_store(spark, folder):
    supplier = _read(spark, folder, "supplier")
    typed = F.explode(
        F.array(
            F.upper("s_name"),
            F.expr("substring(s_name, 10, 8)"),
            F.expr("substring(s_name, 15, 4)"),
            F.concat(F.lit("at "), "s_name"),
            F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")),
        )
    ).alias("typed")
    return resolve.resolve_names(
        supplier.select(typed), sample.stores(spark, folder), "store_name"
    )


# --- trends ------------------------------------------------------------------------------


@_query
def aov_trend_verdict(spark, folder):
    return trend.aov_verdict(sample.star(spark, folder), START, END)


@_query
def aov_period_compare(spark, folder):
    return trend.aov_compare(
        sample.star(spark, folder), ("1997-01-01", "1997-06-30"), ("1997-06-01", "1997-12-31")
    )


@_query
def aov_trend_last_days(spark, folder):
    return trend.aov_recent(sample.star(spark, folder))


@_query
def product_revenue_month(spark, folder):
    return facts.product_revenue_month(sample.star(spark, folder), "red widget", "1998-02")


# --- question log ------------------------------------------------------------------------


@_query
def conv_last_n(spark, folder):
    return questions.last_questions(_read(spark, folder, "conversations"), 2)


@_query
def conv_first_question(spark, folder):
    return questions.first_question(_read(spark, folder, "conversations"))


@_query
def conv_prev_question(spark, folder):
    return questions.previous_question(_read(spark, folder, "conversations"))


@_query
def question_followup(spark, folder):
    flagged = questions.follow_up(_read(spark, folder, "conversations"), FOLLOW_UP_WORDS)
    return flagged.select("conv_id", "turn", F.col("is_follow_up").cast("int").cast("bigint").alias("is_follow_up"))


@_query
def question_route(spark, folder):
    """The plan is made from the log: where no rule fires, all its fields come back."""
    short = F.length("text") % 3 == 0
    plan = {
        "tool": F.when(short, "daily_sales").otherwise("product_revenue"),
        "order": F.when(short, "asc"),
        "limit": F.length("text") % 7,
        "category": F.substring("text", 1, 3),
        "product_name": F.substring("text", 2, 5),
        "store_name": F.col("role"),
        "start_date": F.when(short, START),
        "end_date": F.when(~short, END),
    }
    return questions.route(_read(spark, folder, "conversations"), planned=plan, **QUESTION_WORDS)


def _drawn(values: list, step: int) -> Column:
    """One of the values for each turn of the log."""
    place = F.pmod(F.col("conv_id") * step + F.col("turn") * (step + 2) + F.length("text"), F.lit(len(values)))
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), place.cast("int"))


@_query
def question_answers(spark, folder):
    """Every question of the log with the rows that answer its plan; where no rule fires the plan has drawn arguments."""
    plan = {
        "tool": _drawn(TOOLS, 1),
        "order": _drawn(["asc", "desc", None], 2),
        "limit": F.length("text") % 9 - 1,
        "category": _drawn(TYPED_CATEGORIES, 3),
        "product_name": _drawn(TYPED_PRODUCTS, 4),
        "store_name": _drawn(TYPED_STORES, 5),
        "start_date": _drawn(list(TYPED_DATES), 6),
        "end_date": _drawn(list(TYPED_DATES)[::-1], 7),
    }
    routed = questions.route(_read(spark, folder, "conversations"), planned=plan, **QUESTION_WORDS)
    return answers.question_answers(routed, sample.star(spark, folder))


# --- ranges ------------------------------------------------------------------------------


@_query
def orders_in_ranges(spark, folder):
    """Customers take the place of orders, so that one comes on several days; each part gives a range of a priority."""
    orders = _read(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("order_id"))
    sales = sample.sales(spark, folder).withColumnRenamed("order_id", "o_orderkey").join(orders, "o_orderkey")
    k = F.col("p_partkey")
    part = _read(spark, folder, "part")
    priorities = _read(spark, folder, "orders").select(F.sort_array(F.collect_set("o_orderpriority")).alias("all"))
    first = F.date_add(F.lit("1995-01-01").cast("date"), (k * 37 % 2400).cast("int"))
    asked = part.join(priorities).select(
        "p_partkey",
        F.get("all", (k % F.size("all")).cast("int")).alias("payment"),
        F.when(k % 29 != 0, first).alias("first"),
        F.when(k % 31 != 0, F.date_add(first, (F.col("p_size") * 9 - 20).cast("int"))).alias("last"),
    )
    found = ranges.measures_in_ranges(sales, asked, "payment")
    return found.withColumn("revenue", as_revenue()).drop(TOTAL)


@_query
def date_loose(spark, folder):
    """Order dates typed in eight ways and read back."""
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 8
    spelled = F.when(k == 0, day.cast("string"))
    for i, form in enumerate(["MMMM d, yyyy", "d MMM yy", "M/d/yyyy", "yyyyMMdd'T'HHmmss", "EEEE, MMM d, yyyy", "yyyy.MM.dd h:mm a", "MMMM yyyy"], 1):
        spelled = spelled.when(k == i, F.date_format(day, form))
    typed = _read(spark, folder, "orders").select(k.alias("way"), day.alias("order_date"), spelled.alias("typed"))
    read = typed.select("way", "order_date", loose_date(F.col("typed")).alias("read"))
    return read.groupBy("way", "order_date", "read").agg(F.count(F.lit(1)).alias("row_count"))


# --- ad-hoc SQL --------------------------------------------------------------------------


@_query
def adhoc_sql(spark, folder):
    return adhoc.query(spark, sample.star(spark, folder), ADHOC_SQL)
