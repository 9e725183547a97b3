"""Working-day arithmetic for a Sunday-to-Thursday week, as plain column expressions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sunday_index(day: Column) -> Column:
    return F.dayofweek(day) - 1  # Sunday 0 .. Saturday 6


def is_business_day(day: Column) -> Column:
    return _sunday_index(day) <= 4


def add_business_days(day: Column, n: Column | int) -> Column:
    """The n-th working day after ``day``; a Friday or Saturday counts from the Thursday before."""
    n = F.lit(n) if isinstance(n, int) else n
    weekday = _sunday_index(day)
    slot = F.least(weekday, F.lit(4))
    weekends = F.floor((slot + n) / F.lit(5)).cast("int")
    return F.date_add(F.date_sub(day, weekday - slot), (n + 2 * weekends).cast("int"))


def next_business_day(day: Column) -> Column:
    """``day`` itself on a working day, else the working day that follows."""
    return F.when(is_business_day(day), day).otherwise(add_business_days(day, 1))


def business_day_number(day: Column) -> Column:
    """Running number of working days up to and including ``day``."""
    # 1970-01-04 was the first Sunday of the epoch: unix day 3.
    weeks = F.floor((F.unix_date(day) - 3) / F.lit(7)).cast("long")
    return weeks * 5 + F.least(_sunday_index(day) + 1, F.lit(5))


def business_days_between(start: Column, end: Column) -> Column:
    """Working days after ``start`` up to and including ``end``."""
    return business_day_number(end) - business_day_number(start)


def add_business_days_with_holidays(
    day: Column, n: Column | int, holidays: Sequence[dt.date]
) -> Column:
    """As ``add_business_days``, stepping over listed holidays as well.

    Each holiday inside the span moves the end by one working day. Taken in date order this is a
    fold over the (short, configured) list, so no calendar table or join is needed.
    """
    on_week_days = sorted({h for h in holidays if h.isoweekday() % 7 <= 4})
    end = add_business_days(day, n)
    if not on_week_days:
        return end
    return F.aggregate(
        F.array(*[F.lit(h) for h in on_week_days]),
        end,
        lambda at, off: F.when((off > day) & (off <= at), add_business_days(at, 1)).otherwise(at),
    )
