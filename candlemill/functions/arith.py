"""Null-safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOT = 100.0


def safe_div(x: Column, y: Column) -> Column:
    """x / y, NULL when y is zero."""
    return x / F.nullif(y, F.lit(0.0))


def whole_lots(cash: float, price: Column) -> Column:
    """Shares that `cash` buys at `price`, rounded down to lots of one hundred."""
    shares = safe_div(F.lit(float(cash)), price)
    return shares - F.pmod(shares, F.lit(LOT))
