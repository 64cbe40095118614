"""Calendar arithmetic on dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONDAY = "1900-01-01"


def day_number(day: Column) -> Column:
    """Days since a fixed Monday."""
    return F.datediff(day, F.to_date(F.lit(MONDAY)))


def business_day_gap(start: Column, end: Column) -> Column:
    """Weekdays from `start` to `end`, both included, less one. Holidays count as weekdays."""
    return _weekdays_before(day_number(end) + 1) - _weekdays_before(day_number(start)) - 1


def _weekdays_before(day: Column) -> Column:
    return 5 * F.floor(day / 7) + F.least(F.pmod(day, F.lit(7)), F.lit(5))
