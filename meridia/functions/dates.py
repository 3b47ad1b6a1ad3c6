"""Effective dates: windows are inclusive at both ends and a null end is open."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def covers(day, start: str | Column, end: str | Column, open_end: bool = True) -> Column:
    """The window holds the day. open_end=False leaves out rows without an end."""
    day = day if isinstance(day, Column) else F.lit(day)
    inside = col(end) >= day
    return (col(start) <= day) & ((col(end).isNull() | inside) if open_end else (col(end).isNotNull() & inside))


def overlaps(low, high, start: str | Column, end: str | Column) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return (col(start) <= high) & (col(end).isNull() | (col(end) >= low))


def within(low, high, start: str | Column, end: str | Column) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return (col(start) >= low) & (col(end) <= high)


def quarter_bounds(year: int, quarter: int) -> tuple[dt.date, dt.date]:
    first = dt.date(year, 3 * quarter - 2, 1)
    after = dt.date(year + quarter // 4, 3 * quarter % 12 + 1, 1)
    return first, after - dt.timedelta(days=1)


def decoded_quarter(c: str | Column) -> tuple[Column, Column]:
    """Year and quarter of a YYYYQ number; null where the quarter is not 1 to 4."""
    x = col(c).cast("long")
    good = (x % 10).between(1, 4)
    return F.when(good, F.floor(x / 10).cast("int")), F.when(good, (x % 10).cast("int"))


@dataclass(frozen=True)
class Period:
    """The days that a valuation asks about."""

    low: dt.date
    high: dt.date


def period(year: int, quarter: int | None = None, day: dt.date | None = None) -> Period:
    """A given day, else the quarter, else the whole year."""
    if day:
        return Period(day, day)
    return Period(*quarter_bounds(year, quarter)) if quarter else Period(dt.date(year, 1, 1), dt.date(year, 12, 31))
