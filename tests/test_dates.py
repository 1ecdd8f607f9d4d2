"""Days as people type them, against the parser that reads single bounds."""

from __future__ import annotations

import warnings
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallymart.functions import bounds
from tallymart.functions.dates import loose_date

TYPED = [
    "2026", "May 2026", "1 May 26", "05/01/26", "Friday, May 1, 2026", "2026-05-01 10", "2026-05-01 10:00 PM", "20260501T100000",
    "2026-05-01T10:00:00.123456789", "2026-05-01 10:00 +09:00", "202611", "2026-05", "2026/05", "2026.05", "05/2026", "05.2026", "5-2026",
    "2026-1-2", "20260501", "2026.05.01", "13/05/2026", "05.13.2026", "1.2.2026", "2026-13-01", "2026-02-30", "May 1", "May",
    "1st May 2026", "May 1st, 2026", "Sept 5, 2026", "Sep. 5, 2026", "2026 May 1", "2026-May-01", "01-May-2026", "01May2026",
    "2026-05-01T10:00Z", "2026-05-01 10:00 UTC", "2026-05-01 10:00 EST", "2026-W18", "2026-121", "2026121", "Q2 2026", "2026Q2", "2026-Q2",
    "2026q4", "1/2/3", "31/12/99", "12/31/68", "12/31/69", "12/31/70", "12/31/75", "12/31/77", "2026-05-01 25:00", "2026-05-01 10:60", "10",
    "1", "31", "100", "1998", "0", "99999", "1746057600", "2026-05-01T24:00:00", "2026-05-01 24:00", "2026-5", "2026 5", "2026 5 1",
    "2026 05 01", "05 01 2026", "2026-05-01 10pm", "2026-05-01 10 PM", "10:00 2026-05-01", "Fri 1 May 2026", "Fri May 1 10:00:00 2026",
    "Fri, 01 May 2026 10:00:00 GMT", "Mon May 1 2026", "nan", "NaT", "None", "", " ", "abc", "2026-05-01abc", "2026-05-01 abc",
    "1677-01-01", "2262-04-12", "9999-12-31", "0001-01-01", "1/1/0001", "2026年5月1日", "2026-05-01T", "20260501 10:00", "20260501100000",
    "202605011000", "2026050110", "2026-05-01-10", "May-2026", "2026-May", "may 1, 26", "5/26", "05/26", "26/05", "26-05-01", "26.05.01",
    "260501", "120526", "99-12-31", "2026-05-01, 10:00", "2026-05-01 @ 10:00", "2026-05-01 10:00:00 AM", "2026-05-01 13:00 PM",
    "2026-05-01 00:30 AM", "2026-05-01 10:00+0900", "2026-05-01 10:00 +9", "2026-05-01 10h", "2026-05-01 10h30m", "2026_05_01",
    "2026\\05\\01", "05-2026", "2026-00-01", "00/01/2026", "2026-05-00", "1/0/2026", "2026-05-01 10:00:00.5", "2026-05-01\n",
    "\t2026-05-01", "december 24 2025", "24 december 2025", "Dec 24, 25", "24-Dec-25", "25-Dec-24", "2025 december", "June 3rd 2026",
    "3 June, 2026", "3. June 2026", "Jul 2026", "tuesday 5 may 2026", "Thurs, 7 May 2026", "May 05 2026 3pm", "5/1/2026 3:15 PM",
    "2026-05-01T03:15:00-0700", "2026-05-01 03:15:00.250 PM", "12/12/12", "01/02/03", "2026-06-31", "29 Feb 2024", "29 Feb 2025",
    "2024-02-29", "99-Jan-01", "01-Jan-99", "Jan-99-01", "1 99 Jan", "someday", "1998/02/10 08:30", "2026-05-01 1:05", "2026-05-01 1:5",
    "2026-5-1T9:00", "20260532", "20261301", "00000000", "2026 Q1", "Q1-2026", "may-5-2026", "5.may.2026", "5,may,2026",
    "2026-05-01 10:00 am", "2026-05-01 10:00:00Z", "2026-05-01T10", "2026-05-01T10:00:00+00:00", "2026-05-01 23:59:59", "2026/5/1 0:00",
    "2026 may", "may 26", "jan 32", "32 jan", "apr 99",
]


def read(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        day = pd.to_datetime(text, errors="coerce")
    return None if pd.isna(day) else day.date()


def test_a_column_is_read_like_single_bounds(spark):
    rows = spark.createDataFrame([(t,) for t in TYPED], "t string").select("t", loose_date(F.col("t")).alias("d")).collect()
    assert {r["t"]: r["d"] for r in rows} == {t: read(t) for t in TYPED}
    assert {t: bounds.loose_day(t) for t in TYPED} == {t: read(t) for t in TYPED}


def test_ten_spellings():
    for text in [
        "2026", "May 2026", "1 May 26", "05/01/26", "Friday, May 1, 2026", "2026-05-01 10", "2026-05-01 10:00 PM",
        "20260501T100000", "2026-05-01T10:00:00.123456789", "2026-05-01 10:00 +09:00",
    ]:
        assert bounds.loose_day(text) == (date(2026, 1, 1) if text == "2026" else date(2026, 5, 1))
    assert bounds.loose_day("202611") is None


@pytest.mark.parametrize("year", [1999, 2026, 2049, 2050, 2051, 2099])
def test_years_of_two_digits_lie_within_fifty_years(spark, year):
    texts = spark.range(100).select(F.format_string("%02d-Jan-15", "id").alias("t"), "id")
    texts = texts.select("id", loose_date(F.format_string("15-Jan-%02d", "id"), date(year, 1, 1)).alias("d"))
    for r in texts.collect():
        near = [y for y in range(year - 50, year + 50) if y % 100 == r["id"]]
        assert r["d"] == date(near[0], 1, 15)


def test_today_and_odd_values(spark):
    rows = spark.createDataFrame([("today",), (" NOW ",), (None,), ("x" * 100_000,)], "t string")
    day = date(2026, 7, 31)
    assert [r[0] for r in rows.select(loose_date(F.col("t"), day)).collect()] == [day, day, None, None]
    assert bounds.loose_day(5) is None and bounds.loose_day("  ") is None
