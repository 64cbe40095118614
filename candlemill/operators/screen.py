"""The breakout screen and the signals it yields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlemill.functions import amplitude, amplitude_limit
from candlemill.operators.finance import with_statement
from candlemill.operators.keyed import KEY
from candlemill.operators.windows import CAP_UNIT
from candlemill.params import ScreenParams

BREAKOUT_MARGIN = 1.01
SIGNAL_COLUMNS = (
    "stock_code", "stock_name", "trade_date", "adj_close", "support_price", "float_cap", "total_cap",
    "latest_net_profit", "latest_revenue", "net_profit_yoy", "revenue_yoy",
    "industry_level1", "industry_level2", "industry_level3",
)


def amplitude_ok(params: ScreenParams) -> Column:
    """Whether the amplitude of the previous bars is within the limit of the stock's board."""
    limit = amplitude_limit(F.col(KEY), params.main_amplitude, params.growth_amplitude)
    return amplitude(F.col("max_high"), F.col("min_low"), F.col("first_open")) <= limit


def is_breakout(params: ScreenParams) -> Column:
    """Whether a bar closes more than one percent above the previous highest close, under the other conditions."""
    found = (
        (F.col("rn") > params.history_bars)
        & (F.col("adj_close") > F.col("max_close") * BREAKOUT_MARGIN)
        & amplitude_ok(params)
        & F.col("float_cap").between(params.min_cap, params.max_cap)
    )
    return found & (F.col("has_gain") == 1) if params.require_gain else found


def breakout_screen(stats: DataFrame, params: ScreenParams) -> DataFrame:
    """The bars that break out."""
    return stats.filter(is_breakout(params))


def signals(
    screened: DataFrame, finance: DataFrame, params: ScreenParams, split: bool = False
) -> DataFrame:
    """Screened bars with the growth of the latest statements, rounded; optionally only those that grew enough."""
    bars = screened.select(
        KEY, "stock_name", "trade_date", "adj_close", "max_close", "float_cap", "total_cap",
        "industry_level1", "industry_level2", "industry_level3",
    )
    joined = with_statement(bars, finance, params, split)
    if params.require_growth:
        joined = joined.filter(
            (F.col("net_profit_yoy") >= params.profit_growth) & (F.col("revenue_yoy") >= params.revenue_growth)
        )
    return joined.select(
        KEY, "stock_name", "trade_date",
        F.round("adj_close", 2).alias("adj_close"),
        F.round("max_close", 2).alias("support_price"),
        F.round("float_cap", 2).alias("float_cap"),
        F.round("total_cap", 2).alias("total_cap"),
        F.round(F.col("latest_net_profit") / CAP_UNIT, 2).alias("latest_net_profit"),
        F.round(F.col("latest_revenue") / CAP_UNIT, 2).alias("latest_revenue"),
        "net_profit_yoy", "revenue_yoy", "industry_level1", "industry_level2", "industry_level3",
    )
