"""Display projections and writers of the results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlemill.operators.report import REPORT_NAMES, TOTAL_VALUE_LABEL
from candlemill.params import ScreenParams

# Signal column -> display name; {n} is the number of previous bars.
SIGNAL_NAMES = {
    "stock_code": "股票代码",
    "stock_name": "股票名称",
    "trade_date": "交易日期",
    "adj_close": "前复权_收盘价",
    "support_price": "前复权_前{n}天最高收盘价",
    "float_cap": "流市值(亿)",
    "total_cap": "总市值(亿)",
    "latest_net_profit": "季净利润(亿)",
    "latest_revenue": "季总营收(亿)",
    "net_profit_yoy": "净利润同比增长率",
    "revenue_yoy": "营收同比增长率",
    "industry_level1": "所属领域1",
    "industry_level2": "所属领域2",
    "industry_level3": "所属领域3",
}
DIP_COLUMNS = ("stock_code", "stock_name", "breakthrough_date", "dip_date", "support_date", "support_price")


def display_signals(signals: DataFrame, params: ScreenParams) -> DataFrame:
    """Signals under their display names."""
    return signals.select(
        *(F.col(c).alias(name.format(n=params.history_bars)) for c, name in SIGNAL_NAMES.items())
    )


def display_report(report: DataFrame) -> DataFrame:
    """The report under its display names, in export order; the total row carries a label among the day limits."""
    is_total = F.col("no").isNull()
    label = F.when(is_total, F.lit(TOTAL_VALUE_LABEL)).otherwise(F.col("max_holding_days").cast("string"))
    shown: dict[str, Column] = {c: F.col(c) for c in REPORT_NAMES} | {"max_holding_days": label}
    return report.select(*(column.alias(REPORT_NAMES[c]) for c, column in shown.items()))


def write_signals(signals: DataFrame, params: ScreenParams, path: str) -> None:
    """Signals as CSV with a header, ordered by code and date. Writes whatever their number."""
    ordered = signals.orderBy("stock_code", "trade_date")
    display_signals(ordered, params).write.mode("overwrite").option("header", True).csv(path)


def write_dips(dips: DataFrame, path: str) -> None:
    """Dips as CSV with a header, six columns, dates as yyyy-MM-dd."""
    dips.select(*DIP_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """The report as CSV with a header, by number, the total row last."""
    ordered = report.orderBy(F.col("no").asc_nulls_last())
    display_report(ordered).write.mode("overwrite").option("header", True).csv(path)
