"""Date helpers.

The month difference counts calendar-month boundaries (Jan 31 -> Feb 1 is one
month), unlike Spark's ``months_between`` / ``datediff(MONTH, ..)`` which
count whole months.  Truncation uses ``trunc`` so results stay ``DateType``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the spreadsheet's "no date" marker is any date in year 1899.
SENTINEL_YEAR = 1899


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_date(value) -> Column:
    """A date literal from a ``datetime.date``/ISO string, or a Column as is."""
    if isinstance(value, Column):
        return value
    if value is None:
        return F.current_date()
    if isinstance(value, str):
        value = _dt.date.fromisoformat(value)
    return F.lit(value)


def month_diff(start, end) -> Column:
    """Number of month boundaries from ``start`` to ``end`` (NULL in, NULL out)."""
    s, e = _c(start), _c(end)
    return (F.year(e) - F.year(s)) * 12 + (F.month(e) - F.month(s))


def month_start(d) -> Column:
    return F.trunc(_c(d), "month")


def year_start(d) -> Column:
    return F.trunc(_c(d), "year")


def snapshot_month(d) -> Column:
    """First of the previous month when the day is 1..5, else first of the month."""
    return F.trunc(F.date_sub(_c(d), 5), "month")


def is_sentinel(d) -> Column:
    return F.year(_c(d)) == SENTINEL_YEAR


def fmt_mdy(d) -> Column:
    return F.date_format(_c(d), "MM/dd/yyyy")


def fmt_mdy_short(d) -> Column:
    return F.date_format(_c(d), "MMddyy")


def lenient_date(c, pattern: str = "M/d/yyyy") -> Column:
    """Parse text as a date; anything unparseable becomes NULL instead of failing."""
    return F.try_to_date(_c(c), pattern)
