from __future__ import annotations

from tallymart import schema
from tallymart.operators import audit
from tallymart.plans import batch

EXPECTED = {
    ("basic_info", None, "row_count"): "14",
    ("basic_info", None, "column_count"): "7",
    ("basic_info", "qty", "dtype"): "str",
    ("missing_values", "amount", "missing_count"): "1",
    ("missing_values", "amount", "missing_rate"): "0.071429",
    ("missing_values", "payment", "missing_count"): "1",
    ("missing_values", "date", "missing_rate"): "0.000000",
    ("duplicate_rows", None, "row_count"): "2",
    ("order_id", "order_id", "unique_order_ids"): "12",
    ("order_id", "order_id", "duplicate_order_id_value_count"): "2",
    ("order_id", "order_id", "duplicate_order_id_row_count"): "4",
    ("dates", "date", "unparseable_count"): "1",
    ("dates", "date", "separator_-"): "12",
    ("dates", "date", "separator_/"): "1",
    ("dates", "date", "separator_."): "1",
    ("dates", "date", "separator_other"): "0",
    ("dates", "date", "min_date"): "2026-05-01",
    ("dates", "date", "max_date"): "2026-07-31",
    ("foreign_keys", "store_id", "invalid_count"): "3",
    ("foreign_keys", "store_id", "invalid_value S99"): "2",
    ("foreign_keys", "store_id", "invalid_value s01"): "1",
    ("foreign_keys", "product_id", "invalid_count"): "3",
    ("foreign_keys", "product_id", "invalid_value P99"): "2",
    ("foreign_keys", "product_id", "invalid_value p01"): "1",
    ("qty", "qty", "missing_count"): "0",
    ("qty", "qty", "non_numeric_count"): "1",
    ("qty", "qty", "less_or_equal_zero_count"): "2",
    ("amount", "amount", "missing_count"): "1",
    ("amount", "amount", "currency_symbol_count"): "2",
    ("amount", "amount", "non_numeric_count"): "1",
    ("amount", "amount", "less_or_equal_zero_count"): "1",
    ("amount", "amount", "negative_count"): "1",
    ("amount", "amount", "zero_count"): "0",
}


def found(report, table="sales"):
    return {
        (r["section"], r["column_name"], r["metric"]): r["value"]
        for r in report.where(report.table_name == table).collect()
    }


def test_report(raw):
    metrics = found(batch.audit_report(raw))
    assert {key: metrics.get(key) for key in EXPECTED} == EXPECTED


def test_report_of_dimensions(raw):
    metrics = found(batch.audit_report(raw), "products")
    assert metrics["basic_info", "unit_price", "dtype"] == "float64"
    assert metrics["basic_info", "product_id", "dtype"] == "str"
    assert metrics["primary_key", "product_id", "duplicate_count"] == "0"


def test_report_survives_json(spark, raw, tmp_path):
    path = str(tmp_path / "report")
    report = batch.audit_report(raw)
    batch.write_report(report, path)
    again = spark.read.schema(schema.all_text(audit.REPORT)).json(path)
    assert found(again) == found(report)


def test_absent_columns(spark, raw):
    m = found(audit.audit_sales(raw.sales.select("payment"), raw.stores, raw.products))
    for section, column in [
        ("order_id", "order_id"), ("dates", "date"), ("qty", "qty"), ("amount", "amount"),
        ("foreign_keys", "store_id"), ("foreign_keys", "product_id"),
    ]:
        assert m[section, column, "exists"] == "false"
    no_key = found(audit.foreign_key(raw.sales, raw.stores, "sales", "store_id", "nope"))
    assert no_key["foreign_keys", "store_id", "reference_column_exists"] == "false"
    dup = found(audit.duplicate_keys(raw.stores, "sales", "nope"))
    assert dup["primary_key", "nope", "duplicate_count"] == "0"


def test_null_keys_are_equal_to_each_other(spark):
    df = spark.createDataFrame([(None,), (None,), ("a",)], "order_id string")
    dup = found(audit.duplicate_keys(df, "sales", "order_id"))
    assert dup["primary_key", "order_id", "duplicate_count"] == "2"
    ids = found(audit.order_ids(df, "sales"))
    assert ids["order_id", "order_id", "unique_order_ids"] == "1"
    assert ids["order_id", "order_id", "duplicate_order_id_value_count"] == "0"
    assert ids["order_id", "order_id", "duplicate_order_id_row_count"] == "2"


def test_null_reference_is_the_empty_value(spark, raw):
    df = spark.createDataFrame([(None,), (" S01 ",)], "store_id string")
    m = found(audit.foreign_key(df, raw.stores, "sales", "store_id", "store_id"))
    assert m["foreign_keys", "store_id", "invalid_count"] == "1"
    assert m["foreign_keys", "store_id", "invalid_value "] == "1"


def test_types_by_content(spark):
    rows = [("1", "1.5", "True", None, "1", "1"), ("-2", "3", "False", None, None, "x")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string")
    m = found(audit.basic_info(df, "sales"))
    types = [m["basic_info", c, "dtype"] for c in "abcdef"]
    assert types == ["int64", "float64", "bool", "float64", "float64", "str"]


def test_empty_table(spark):
    df = spark.createDataFrame([], schema.RAW_SALES)
    m = found(audit.missing_values(df, "sales"))
    assert m["missing_values", "qty", "missing_rate"] == "0.000000"
    assert found(audit.duplicate_rows(df, "sales"))["duplicate_rows", None, "row_count"] == "0"
    assert found(audit.dates(df, "sales"))["dates", "date", "min_date"] is None


def _reads(df) -> int:
    """Scans of the fact in the plan that ran; a reused exchange has no scan of its own."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    return sum("order_id" in line or ("store_id" in line and "product_id" in line) for line in scans)


def test_the_fact_is_read_twice(spark, raw, star, tmp_path):
    from tallymart.operators import verify
    from tallymart.plans import batch
    from tallymart.sources.star import Star

    path = str(tmp_path / "raw_sales")
    raw.sales.write.parquet(path)
    stored = Star(spark.read.parquet(path), raw.stores, raw.products)
    assert _reads(batch.audit_report(stored)) == 2
    typed = str(tmp_path / "sales")
    star.sales.write.parquet(typed)
    loaded = Star(spark.read.parquet(typed), star.stores, star.products)
    assert _reads(verify.constraints(loaded)) == 2
    counted = dict.fromkeys(verify.REQUIRED["sales"], 0) | {"qty": 3}
    known = verify.constraints(loaded, counted)
    assert _reads(known) == 1
    assert [tuple(r) for r in known.where("violations > 0").collect()] == [("sales", "not_null", "qty", 3)]
