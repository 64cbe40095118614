"""Forward-adjusted prices."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlemill.functions import safe_div
from candlemill.operators.keyed import KEY, row_hash
from candlemill.sources.shared import keep

BAR_COLUMNS = (
    "stock_code", "stock_name", "trade_date", "open_price", "close_price", "high_price", "low_price",
    "prev_close_price", "market_cap", "total_market_cap", "industry_level1", "industry_level2", "industry_level3",
)
# Total order of a stock's bars. `version` is a hash of a bar's other columns: it orders several versions of one date.
BAR_ORDER = ("trade_date", "version")
LOG_UNITS = 1e15
DRILLDOWN_COLUMNS = (
    "stock_code", "stock_name", "trade_date", "open_price", "close_price", "high_price", "low_price",
    "prev_close_price", "market_cap", "industry_level2", "industry_level3", "volume",
)


def dated_bars(bars: DataFrame, columns: Sequence[str] = BAR_COLUMNS) -> DataFrame:
    """The columns in use, without rows that name no stock or no date."""
    return bars.select(*columns).filter(F.col(KEY).isNotNull() & F.col("trade_date").isNotNull())


def distinct_bars(bars: DataFrame, columns: Sequence[str] = BAR_COLUMNS) -> DataFrame:
    """Bars without exact copies; copies merge before the shuffle, so they may be any number."""
    return dated_bars(bars, columns).distinct()


def adjusted_bars(
    bars: DataFrame, split: bool = False, columns: Sequence[str] = BAR_COLUMNS, tasks: int | None = None
) -> DataFrame:
    """Distinct bars with `version`, `factor`, the running product of close to previous close, and the adjusted prices.

    Factors need a stock's whole history, so date filters belong after this operator. `tasks` is the number of parts the
    bars are dealt into, Spark's own choice when not given.
    """
    rows = dated_bars(bars, columns)
    factored = _factor_by_day(rows) if split else _factor_by_bar(rows, tasks)
    return _with_adjusted(factored)


def _with_adjusted(factored: DataFrame) -> DataFrame:
    adjusted = factored.withColumn(
        "adj_close", F.col("factor") * safe_div(F.col("last_close"), F.col("last_factor"))
    )
    return adjusted.withColumns({
        f"adj_{name}": safe_div(F.col(f"{name}_price"), F.col("close_price")) * F.col("adj_close")
        for name in ("open", "high", "low", "prev_close")
    }).drop("last_close", "last_factor")


def _log_rise() -> Column:
    """Log of a bar's rise, in units of 1e-15. Sums of whole numbers are the same in any order and grouping."""
    rise = safe_div(F.col("close_price"), F.col("prev_close_price")) - 1
    return F.round(F.ln(1 + rise) * LOG_UNITS).cast("long")


def _as_factor(units: Column) -> Column:
    return F.exp(units / LOG_UNITS)


def _factor_by_bar(bars: DataFrame, tasks: int | None) -> DataFrame:
    """Copies and all windows of a stock on one exchange and one sort."""
    dealt = bars.repartition(tasks, KEY) if tasks else bars.repartition(KEY)
    to_date = Window.partitionBy(KEY).orderBy("trade_date")
    last = F.max(F.struct(*BAR_ORDER, "close_price", "factor")).over(Window.partitionBy(KEY))
    factored = (
        _versioned(dealt.distinct())
        .sortWithinPartitions(KEY, *BAR_ORDER)
        .withColumn("factor", _as_factor(F.sum(_log_rise()).over(to_date)))
    )
    return factored.withColumn("_last", last).select(
        *factored.columns, F.col("_last.close_price").alias("last_close"), F.col("_last.factor").alias("last_factor")
    )


def _factor_by_day(bars: DataFrame) -> DataFrame:
    """The same through one row per stock and date: bars of a date share their factor, and dates are few."""
    rows = keep(_versioned(bars.distinct()), "hot_bars")
    days = rows.groupBy(KEY, "trade_date").agg(
        F.sum(_log_rise()).alias("log_rise"), F.max(F.struct("version", "close_price")).alias("bar")
    )
    to_date = Window.partitionBy(KEY).orderBy("trade_date")
    days = days.select(KEY, "trade_date", "bar", _as_factor(F.sum("log_rise").over(to_date)).alias("factor"))
    last = F.max(F.struct("trade_date", "bar.close_price", "factor")).over(Window.partitionBy(KEY))
    days = days.withColumn("_last", last).select(
        KEY, "trade_date", "factor",
        F.col("_last.close_price").alias("last_close"), F.col("_last.factor").alias("last_factor"),
    )
    return rows.join(days, [KEY, "trade_date"])


def _versioned(rows: DataFrame) -> DataFrame:
    return rows.withColumn("version", row_hash(rows, KEY, "trade_date"))


def drilldown(bars: DataFrame, code: str, first_day: date, day: date) -> DataFrame:
    """One stock's adjusted bars of one day, the stock named in any case.

    The factor of the day and of the last bar are sums over the stock's history, so no task holds the whole stock.
    """
    one = bars.filter(F.col(KEY).isin(sorted({code, code.lower(), code.upper()})))
    rows = _versioned(distinct_bars(one, DRILLDOWN_COLUMNS))
    units = _log_rise()
    history = rows.groupBy(KEY).agg(
        _as_factor(F.sum(F.when(F.col("trade_date") <= F.lit(day), units))).alias("factor"),
        _as_factor(F.sum(units)).alias("last_factor"),
        F.max(F.struct(*BAR_ORDER, "close_price")).alias("last"),
    )
    history = history.withColumnRenamed("last", "_last").withColumn("last_close", F.col("_last.close_price")).drop("_last")
    shown = F.col("trade_date").between(first_day, day) & (F.col("trade_date") == day)
    return (
        _with_adjusted(rows.filter(shown).join(history, KEY))
        .select(
            KEY, "trade_date", "stock_name", "volume",
            F.col("adj_close").alias("close"), F.col("adj_high").alias("high"),
            F.col("adj_low").alias("low"), F.col("adj_open").alias("open"),
            "industry_level2", "industry_level3",
        )
        .orderBy("trade_date")
    )
