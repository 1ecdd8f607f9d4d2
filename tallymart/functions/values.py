"""Text, date and number expressions. Nothing here raises on bad input: bad becomes null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.schema import MONEY

# The white space that Python's str.strip removes.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Accepted number spelling; suffixes (12d), inf and nan are not numbers.
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
INTEGER = r"[+-]?[0-9]+"

# The date spellings, one separator per date, day and month of 1-2 digits, years
# from 1. The last alternative takes everything else, so that one replacement both reorders the
# parts of a date and empties what is not one.
_DATE = (
    r"(?s)^(?:(?!0000)([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})"
    r"|([0-9]{1,2})([-/.])([0-9]{1,2})\6(?!0000)([0-9]{4}))$|^.*$"
)
_DATE_ISO = "$1$8-$3$7-$4$5"
_DATE_YEAR_FIRST = r"(?s)^(?!0000)([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})$|^.*$"
_DATE_YEAR_FIRST_ISO = "$1-$2-$3"

# Currency signs; the comma is the thousands separator.
CURRENCY_SIGNS = "¥￥"


# Each expression below names its input once: Catalyst copies expressions when it merges
# projections and pushes filters, and every copy is computed again. ``computed_once`` is for
# cells that several later expressions look at.


def computed_once(df: DataFrame, cells: dict[str, Column], keep: list[Column]) -> DataFrame:
    """The ``keep`` columns and the given cells, each cell evaluated exactly once per row.

    Inlining a one-element array keeps filters on the cells from being pushed below it, where
    they would evaluate the parsing a second time.
    """
    row = F.struct(*[value.alias(name) for name, value in cells.items()])
    return df.select(*keep, F.inline(F.array(row)))


def strip(col: Column) -> Column:
    """Trim Unicode white space, not only the ASCII space that ``trim`` removes by default."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def normalize_id(col: Column) -> Column:
    return F.upper(strip(col))


def parse_date(col: Column) -> Column:
    """Six spellings: year first or day first, with ``-``, ``/`` or ``.`` used throughout."""
    return F.regexp_replace(strip(col), _DATE, _DATE_ISO).try_cast("date")


def parse_date_year_first(col: Column) -> Column:
    """Dashboard parsing: separators are interchangeable, but only year-month-day passes."""
    return F.regexp_replace(strip(col), _DATE_YEAR_FIRST, _DATE_YEAR_FIRST_ISO).try_cast("date")


def number_text(col: Column) -> Column:
    """The stripped text if it spells a number, otherwise the empty text."""
    return F.regexp_extract(strip(col), f"^({NUMBER})$", 1)


def money_text(col: Column) -> Column:
    """Amount text without currency signs and thousands separators, not yet stripped."""
    return F.translate(col, CURRENCY_SIGNS + ",", "")


def number(col: Column) -> Column:
    """Text to DOUBLE, null where the text is not a plain number."""
    return number_text(col).try_cast("double")


def money(col: Column) -> Column:
    """Amount text to DECIMAL(18,2), rounded half up; null if not a number or too large."""
    return number_text(money_text(col)).try_cast(MONEY)
