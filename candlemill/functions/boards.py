"""Amplitude of a price range and the limit each listing board sets on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code prefixes of the growth boards and of the two main boards.
GROWTH_PREFIXES = ("sz300", "sz301", "sz302", "sh688")
MAIN_PREFIXES = ("sh600", "sh601", "sh603", "sh605", "sz000", "sz001", "sz002", "sz003")
OTHER_LIMIT = 1000.0
NO_BASE = 999999.0


def amplitude(high: Column, low: Column, base: Column) -> Column:
    """Range in percent of its opening price; a huge value when that price is not positive."""
    return F.when(base > 0, (high - low) * 1.0 / base * 100).otherwise(F.lit(NO_BASE))


def amplitude_limit(code: Column, main: float, growth: float) -> Column:
    """Largest amplitude in percent that the board of `code` allows."""
    return (
        F.when(_starts(code, GROWTH_PREFIXES), F.lit(float(growth)))
        .when(_starts(code, MAIN_PREFIXES), F.lit(float(main)))
        .otherwise(F.lit(OTHER_LIMIT))
    )


def _starts(code: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [code.startswith(p) for p in prefixes])
