"""Query arguments, checked on the driver before a plan is built."""

from __future__ import annotations

import warnings
from datetime import date, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


MONTH = "month"


def loose_day(value: object) -> date | None:
    """A bound as a date, a time, or text that names a day; anything else is no bound.

    Texts are read by pandas, in the ways that ``dates.loose_date`` reads a column of them.
    """
    if isinstance(value, datetime):
        return value.date()
    if isinstance(value, date):
        return value
    if not isinstance(value, str) or not value.strip():
        return None
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            day = pd.to_datetime(value, errors="coerce")
        except (ValueError, OverflowError):
            return None
    return None if pd.isna(day) else day.date()


def strict_day(value: str | None, argument: str) -> date | None:
    """A bound that must be YYYY-MM-DD; empty means no bound, anything else is an error."""
    if not value:
        return None
    try:
        return datetime.strptime(value, "%Y-%m-%d").date()
    except (TypeError, ValueError):
        raise ValueError(f"Invalid {argument}: {value}") from None


def between(df: DataFrame, start: date | None, end: date | None, column: str = "date") -> DataFrame:
    """Inclusive range with open ends; a set bound also drops null dates.

    Where the frame has the month folders of the processed layer, the bounds prune them too.
    """
    folders = MONTH in df.columns and column == "date"
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start))
        if folders:
            df = df.where(F.col(MONTH) >= start.strftime("%Y-%m"))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end))
        if folders:
            df = df.where(F.col(MONTH) <= end.strftime("%Y-%m"))
    return df


def between_loose(df: DataFrame, start: object, end: object, column: str = "date") -> DataFrame:
    return between(df, loose_day(start), loose_day(end), column)


def between_strict(
    df: DataFrame, start: str | None, end: str | None, column: str = "date"
) -> DataFrame:
    first = strict_day(start, "start_date")
    last = strict_day(end, "end_date")
    return between(df, first, last, column)


def tool_limit(value: object) -> int:
    """A tool call's limit argument: an integer between 1 and 100, and 1 when it cannot be read.

    For readers of such arguments only; operators take what they are given.
    """
    try:
        wanted = int(value)  # type: ignore[call-overload]
    except (TypeError, ValueError, OverflowError):
        wanted = 1
    return max(1, min(wanted, 100))


def first_rows(df: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows, or all of them for None; other limits raise."""
    if limit is None:
        return df
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
        raise ValueError(f"Invalid limit: {limit}")
    return df.limit(limit)


def dashboard_limit(value: object) -> int | None:
    """A dashboard's limit: an integer from 1 to 100, or None for all rows; others raise."""
    if value is None:
        return None
    try:
        wanted = int(value)  # type: ignore[call-overload]
    except (TypeError, ValueError, OverflowError):
        raise ValueError(f"Invalid limit: {value}") from None
    if not 1 <= wanted <= 100:
        raise ValueError(f"Invalid limit: {value}")
    return wanted


def by(column: str, order: object) -> Column:
    """Sort key: only the exact word ``asc`` sorts upwards, whatever else is given sorts down."""
    return F.asc_nulls_first(column) if order == "asc" else F.desc_nulls_last(column)
