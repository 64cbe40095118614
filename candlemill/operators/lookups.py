"""Plain look-ups on the two tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.operators.keyed import KEY


def bars_between(bars: DataFrame, first: date, last: date) -> DataFrame:
    """Date, close and volume of the bars in a date range, by date."""
    # Further sort keys let the range partitioning split a date that holds many rows.
    return (
        bars.filter(F.col("trade_date").between(first, last))
        .orderBy("trade_date", KEY, "close_price", "volume")
        .select("trade_date", "close_price", "volume")
    )


def statements_between(finance: DataFrame, first: str, last: str) -> DataFrame:
    """Assets, liabilities and equity of the statements in a range of report dates, by report date."""
    columns = (KEY, "report_date", "B_total_assets", "B_total_liab", "B_total_owner_equity")
    return finance.filter(F.col("report_date").between(first, last)).select(*columns).orderBy(
        "report_date", KEY, *columns[2:]
    )


def row_count(table: DataFrame) -> DataFrame:
    """Number of rows as a one-row table."""
    return table.agg(F.count(F.lit(1)).alias("n_rows"))


def preview(table: DataFrame, n: int = 5) -> DataFrame:
    """The first rows of an ordered table."""
    return table.limit(n)
