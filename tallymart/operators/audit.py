"""Profiling of raw tables. Every result is a DataFrame of

    (table_name, section, column_name, metric, value)

with the value as text. All per-column counts of a table come from one aggregate over one scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymart.functions import values
from tallymart.sources import csv_rows
from tallymart.functions.metrics import half_up

# Type names the report uses.
_TYPE_NAMES = {
    "tinyint": "int8",
    "smallint": "int16",
    "int": "int32",
    "bigint": "int64",
    "float": "float32",
    "double": "float64",
    "boolean": "bool",
}
TEXT_TYPE = "str"
# Cell texts that make a column boolean.
BOOLEANS = ["True", "TRUE", "true", "False", "FALSE", "false"]

REPORT = ["table_name", "section", "column_name", "metric", "value"]
_ROWS = "_rows"


class Metrics:
    """Named aggregates over one table, evaluated together and returned as rows.

    Parsed cells are prepared as columns below the aggregate, so each is parsed once per row
    however many metrics look at it.
    """

    def __init__(self, table_name: str):
        self.table_name = table_name
        self._prepared: dict[str, Column] = {}
        self._counted: dict[str, Column] = {}
        self._lines: list[Column] = []

    def prepare(self, name: str, value: Column) -> Column:
        self._prepared[name] = value
        return F.col(name)

    def add(self, section: str, column: str | None, metric: str, value: Column) -> None:
        """A metric computed by an aggregate."""
        name = f"m{len(self._counted)}"
        self._counted[name] = value
        self._line(section, column, metric, F.col(name))

    def state(self, section: str, column: str | None, metric: str, value: str) -> None:
        """A metric known from the schema alone."""
        self._line(section, column, metric, F.lit(value))

    def _line(self, section: str, column: str | None, metric: str, value: Column) -> None:
        self._lines.append(
            F.struct(
                F.lit(self.table_name).alias("table_name"),
                F.lit(section).alias("section"),
                F.lit(column).cast("string").alias("column_name"),
                F.lit(metric).alias("metric"),
                value.cast("string").alias("value"),
            )
        )

    def rows(self, df: DataFrame) -> DataFrame:
        counted = df.withColumns(self._prepared) if self._prepared else df
        counted = counted.agg(
            F.count(F.lit(1)).alias(_ROWS), *[c.alias(n) for n, c in self._counted.items()]
        )
        return counted.select(F.inline(F.array(*self._lines)))


def _is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def _reported_type(m: Metrics, df: DataFrame, column: str) -> Column:
    """Type name of a column. Text columns are typed by their content, as a CSV reader would:
    all whole numbers, all numbers (or nothing at all), all booleans, otherwise text."""
    if not _is_text(df, column):
        name = df.schema[column].dataType.simpleString()
        return F.max(F.lit(_TYPE_NAMES.get(name, TEXT_TYPE)))
    kind = m.prepare(f"_kind_{column}", _kind(F.col(column)))
    filled, rows = F.count(column), F.count(F.lit(1))
    return (
        F.when(rows == 0, TEXT_TYPE)
        .when(filled == 0, "float64")
        .when((F.max(kind) == _WHOLE) & (filled == rows), "int64")
        .when(F.max(kind) <= _NUMERIC, "float64")
        .when((F.min(kind) == _BOOLEAN) & (F.max(kind) == _BOOLEAN) & (filled == rows), "bool")
        .otherwise(TEXT_TYPE)
    )


# What a cell's text looks like, from the narrowest to the widest.
_WHOLE, _NUMERIC, _BOOLEAN, _TEXT = range(4)


def _kind(text: Column) -> Column:
    # Signs, digits and the point all sort before ":", so most text skips the patterns.
    return (
        F.when(text.isNull(), None)
        .when(text >= ":", F.when(text.isin(BOOLEANS), _BOOLEAN).otherwise(_TEXT))
        .when(text.rlike(rf"^\s*{values.INTEGER}\s*$"), _WHOLE)
        .when(text.rlike(rf"^\s*{values.NUMBER}\s*$"), _NUMERIC)
        .otherwise(_TEXT)
    )


def add_basic_info(m: Metrics, df: DataFrame) -> None:
    """Row and column count, and position and type of each column."""
    m.add("basic_info", None, "row_count", F.count(F.lit(1)))
    m.state("basic_info", None, "column_count", str(len(df.columns)))
    for position, column in enumerate(df.columns):
        m.state("basic_info", column, "position", str(position))
        m.add("basic_info", column, "dtype", _reported_type(m, df, column))


def add_missing(m: Metrics, df: DataFrame) -> None:
    """Null cells per column, as a count and as a rate to six decimals."""
    for column in df.columns:
        missing = F.count_if(F.col(column).isNull())
        m.add("missing_values", column, "missing_count", missing)
        # Rate of nulls, in millionths, by whole numbers; an empty table has rate zero.
        m.add(
            "missing_values",
            column,
            "missing_rate",
            F.coalesce(
                F.expr(
                    half_up(f"cast(count_if({_quoted(column)} is null) as decimal(38, 0)) * 1000000",
                            "count(1)")
                ),
                F.lit(0),
            ).cast("decimal(20, 0)") * F.lit("0.000001").cast("decimal(7, 6)"),
        )


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def add_dates(m: Metrics, df: DataFrame) -> None:
    """Readability of dates, separators used (first of - / . that occurs) and the range."""
    if not _exists(m, "dates", df, "date"):
        return
    cell = F.col("date")
    parsed = m.prepare(
        "_date", values.parse_date(cell) if _is_text(df, "date") else cell.cast("date")
    )
    text = m.prepare("_date_text", values.strip(cell.cast("string")))
    dash, slash, dot = (F.contains(text, F.lit(sign)) for sign in "-/.")
    m.add("dates", "date", "total_count", F.count(F.lit(1)))
    m.add("dates", "date", "unparseable_count", F.count_if(parsed.isNull()))
    m.add("dates", "date", "separator_-", F.count_if(dash))
    m.add("dates", "date", "separator_/", F.count_if(~dash & slash))
    m.add("dates", "date", "separator_.", F.count_if(~dash & ~slash & dot))
    m.add("dates", "date", "separator_other", F.count_if(~dash & ~slash & ~dot))
    m.add("dates", "date", "min_date", F.min(parsed))
    m.add("dates", "date", "max_date", F.max(parsed))


def add_qty(m: Metrics, df: DataFrame) -> None:
    """Missing, unreadable and non-positive quantities."""
    if not _exists(m, "qty", df, "qty"):
        return
    cell = F.col("qty")
    number = m.prepare("_qty", values.number(cell.cast("string")))
    m.add("qty", "qty", "missing_count", F.count_if(cell.isNull()))
    m.add("qty", "qty", "non_numeric_count", F.count_if(number.isNull() & cell.isNotNull()))
    m.add("qty", "qty", "less_or_equal_zero_count", F.count_if(number <= 0))


def add_amount(m: Metrics, df: DataFrame) -> None:
    """Missing, currency-signed, unreadable and non-positive amounts."""
    if not _exists(m, "amount", df, "amount"):
        return
    cell = F.col("amount").cast("string")
    number = m.prepare("_amount", values.number(values.money_text(cell)))
    m.add("amount", "amount", "missing_count", F.count_if(cell.isNull()))
    signed = cell.rlike(f"[{values.CURRENCY_SIGNS}]")
    m.add("amount", "amount", "currency_symbol_count", F.count_if(signed))
    m.add("amount", "amount", "non_numeric_count", F.count_if(number.isNull() & cell.isNotNull()))
    m.add("amount", "amount", "less_or_equal_zero_count", F.count_if(number <= 0))
    m.add("amount", "amount", "negative_count", F.count_if(number < 0))
    m.add("amount", "amount", "zero_count", F.count_if(number == 0))


def _exists(m: Metrics, section: str, df: DataFrame, column: str) -> bool:
    found = column in df.columns
    m.state(section, column, "exists", str(found).lower())
    return found


def basic_info(df: DataFrame, table_name: str) -> DataFrame:
    m = Metrics(table_name)
    add_basic_info(m, df)
    return m.rows(df)


def missing_values(df: DataFrame, table_name: str) -> DataFrame:
    m = Metrics(table_name)
    add_missing(m, df)
    return m.rows(df)


def dates(df: DataFrame, table_name: str) -> DataFrame:
    m = Metrics(table_name)
    add_dates(m, df)
    return m.rows(df)


def quantities(df: DataFrame, table_name: str) -> DataFrame:
    m = Metrics(table_name)
    add_qty(m, df)
    return m.rows(df)


def amounts(df: DataFrame, table_name: str) -> DataFrame:
    m = Metrics(table_name)
    add_amount(m, df)
    return m.rows(df)


def distinct_rows(df: DataFrame) -> DataFrame:
    """Each distinct row with its number of copies as ``_n``.

    Every other grouping can start from here: planned together, they share this exchange, so the
    table itself is read and shuffled once for all of them.
    """
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))


def _in_groups(sizes: DataFrame) -> DataFrame:
    """One row: how many rows lie in groups of two or more."""
    n = F.col("_n")
    return sizes.agg(F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("rows"))


def _per(distinct: DataFrame, key: Column) -> DataFrame:
    """Rows per key, as ``n``."""
    return distinct.groupBy(key).agg(F.sum("_n").alias("n"))


def duplicate_rows(df: DataFrame, table_name: str, distinct: DataFrame | None = None) -> DataFrame:
    """Rows that are identical to another row, all members of a group counted."""
    m = Metrics(table_name)
    m.add("duplicate_rows", None, "row_count", F.max("rows"))
    return m.rows(_in_groups(distinct_rows(df) if distinct is None else distinct))


def duplicate_keys(df: DataFrame, table_name: str, key: str) -> DataFrame:
    """Rows that share their key with another row; null keys are equal to each other."""
    m = Metrics(table_name)
    if key not in df.columns:
        m.state("primary_key", key, "duplicate_count", "0")
        return m.rows(df)
    m.add("primary_key", key, "duplicate_count", F.max("rows"))
    return m.rows(_in_groups(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))))


def order_ids(df: DataFrame, table_name: str, distinct: DataFrame | None = None) -> DataFrame:
    """Distinct ids, repeated ids and the rows they cover. One count per id answers all."""
    m = Metrics(table_name)
    if not _exists(m, "order_id", df, "order_id"):
        return m.rows(df)
    n, known = F.col("n"), F.col("order_id").isNotNull()
    zero = F.lit(0)
    m.add("order_id", "order_id", "total_rows", F.coalesce(F.sum(n), zero))
    m.add("order_id", "order_id", "unique_order_ids", F.count_if(known))
    m.add("order_id", "order_id", "duplicate_order_id_value_count", F.count_if(known & (n > 1)))
    m.add(
        "order_id",
        "order_id",
        "duplicate_order_id_row_count",
        F.coalesce(F.sum(F.when(n > 1, n)), zero),
    )
    counted = df.select("order_id", F.lit(1).alias("_n")) if distinct is None else distinct
    return m.rows(_per(counted, F.col("order_id")))


def foreign_key(
    facts: DataFrame,
    dimension: DataFrame,
    table_name: str,
    fk: str,
    pk: str,
    distinct: DataFrame | None = None,
) -> DataFrame:
    """Sales rows whose trimmed reference is unknown, in total and per value.

    Case matters here; a null reference is the value ``""``. Rows are counted per value before
    the anti join, so the join handles distinct values only.
    """
    m = Metrics(table_name)
    section = "foreign_keys"
    if not _exists(m, section, facts, fk):
        return m.rows(facts)
    m.state(section, fk, "reference_column_exists", str(pk in dimension.columns).lower())
    if pk not in dimension.columns:
        return m.rows(facts)
    counted = facts.select(fk, F.lit(1).alias("_n")) if distinct is None else distinct
    unknown = unknown_values(counted, dimension, fk, pk)
    m.add(section, fk, "invalid_count", F.coalesce(F.sum("n"), F.lit(0)))
    histogram = unknown.select(
        F.lit(table_name).alias("table_name"),
        F.lit(section).alias("section"),
        F.lit(fk).alias("column_name"),
        F.concat(F.lit("invalid_value "), F.col("value")).alias("metric"),
        F.col("n").cast("string").alias("value"),
    )
    return m.rows(unknown).unionByName(histogram)


def unknown_values(counted: DataFrame, dimension: DataFrame, fk: str, pk: str) -> DataFrame:
    """(value, n) of references, weighted by ``_n``, that the dimension lacks."""
    value = values.strip(F.coalesce(F.col(fk).cast("string"), F.lit("")))
    counted = _per(counted, value.alias("value"))
    valid = dimension.where(F.col(pk).isNotNull()).select(
        values.strip(F.col(pk).cast("string")).alias("value")
    )
    return counted.join(valid, "value", "left_anti")


def malformed_rows(rows: DataFrame, table_name: str) -> DataFrame:
    """Rows that do not fit the header, by reason, of a table read by ``csv_rows.read_rows``."""
    m = Metrics(table_name)
    for reason in (csv_rows.SURPLUS, csv_rows.SHORT, csv_rows.UNREADABLE):
        m.add("malformed_rows", None, reason, F.count_if(F.col(csv_rows.MALFORMED) == reason))
    return m.rows(rows)


def audit_sales(sales: DataFrame, stores: DataFrame, products: DataFrame) -> DataFrame:
    """All sales checks: one scan for the cell metrics, one for all groupings."""
    m = Metrics("sales")
    add_basic_info(m, sales)
    add_missing(m, sales)
    add_dates(m, sales)
    add_qty(m, sales)
    add_amount(m, sales)
    distinct = distinct_rows(sales)
    parts = [
        m.rows(sales),
        duplicate_rows(sales, "sales", distinct),
        order_ids(sales, "sales", distinct),
        foreign_key(sales, stores, "sales", "store_id", "store_id", distinct),
        foreign_key(sales, products, "sales", "product_id", "product_id", distinct),
    ]
    return reduce(DataFrame.unionByName, parts)


def audit_dimension(df: DataFrame, table_name: str, key: str) -> DataFrame:
    """Basic info, missing cells, identical rows and repeated keys."""
    m = Metrics(table_name)
    add_basic_info(m, df)
    add_missing(m, df)
    return (
        m.rows(df)
        .unionByName(duplicate_rows(df, table_name))
        .unionByName(duplicate_keys(df, table_name, key))
    )
