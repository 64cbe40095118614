"""Position ledger and profit-and-loss report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.functions import safe_div
from candlemill.operators.keyed import KEY, number_rows
from candlemill.params import TradeParams

# Report column -> display name, in export order, and the labels of the total row.
REPORT_NAMES = {
    "no": "编号",
    "stock_code": "股票代码",
    "stock_name": "股票名称",
    "init_cash": "初始金额",
    "bought_date": "购入日期",
    "total_shares": "总仓位",
    "cost_price": "成本价",
    "trade_date": "结算日期",
    "holding_days": "持有天数",
    "max_holding_days": "最大持有天数",
    "market_value": "市值(元)",
    "profit": "盈亏金额(元)",
    "profit_percent": "盈亏比",
}
TOTAL_LABEL = "总投资金额"
TOTAL_VALUE_LABEL = "总市值"


def position_ledger(positions: DataFrame, trade: TradeParams) -> DataFrame:
    """One row per stock: what all its targets bought and sold against one initial cash.

    Sales on the first holding day are left out, so their shares stay in the position. Targets count in the order of
    `list_pos`; where only the last event matters, the last target (or the last one that sold) decides. All of it is
    aggregation with partial sums, so a stock may have any number of targets.
    """
    rows = positions.withColumns({
        f"{sale}_counts": F.coalesce(F.col(f"{sale}_day") > 1, F.lit(False)) for sale in ("half", "exit")
    })
    sales = {part: [_counted(sale, part) for sale in ("half", "exit")] for part in ("shares", "date")}
    proceeds = [F.when(F.col(f"{s}_counts"), F.col(f"{s}_price") * F.col(f"{s}_shares")) for s in ("half", "exit")]
    rows = rows.withColumns({
        "sold_shares": sum(F.coalesce(c, F.lit(0.0)) for c in sales["shares"]),
        "proceeds": sum(F.coalesce(c, F.lit(0.0)) for c in proceeds),
        "sold_date": F.greatest(*sales["date"]),
        "sold_day": F.coalesce(_counted("exit", "day"), _counted("half", "day")),
        "last_close": F.coalesce(_counted("exit", "bar_close"), _counted("half", "bar_close"), F.col("entry_close")),
    })
    last = F.max(F.struct("list_pos", "breakthrough_date", "stock_name", "support", "last_close",
                          "sold_shares", "proceeds")).alias("last")
    last_sale = F.max(F.when(F.col("sold_day").isNotNull(), F.struct("list_pos", "sold_day"))).alias("last_sale")
    held = F.col("bought_shares") - F.col("sold_shares")
    cash = F.lit(trade.initial_cash) - F.col("spent") + F.col("proceeds")
    # The cost price is set by the last purchase, before the last target sold anything.
    cash_then = F.col("current_cash") - F.col("last.proceeds")
    shares_then = F.col("current_positions") + F.col("last.sold_shares")
    return (
        rows.groupBy(KEY)
        .agg(
            last, last_sale,
            F.min("bought_date").alias("bought_date"),
            F.sum("total_shares").alias("bought_shares"),
            F.sum("cost").alias("spent"),
            F.sum("sold_shares").alias("sold_shares"),
            F.sum("proceeds").alias("proceeds"),
            F.max("sold_date").alias("trade_date"),
        )
        .withColumns({"current_cash": cash, "current_positions": held})
        .select(
            KEY,
            F.col("last.stock_name").alias("stock_name"),
            F.lit(trade.initial_cash).alias("init_cash"),
            F.col("last.breakthrough_date").alias("support_date"),
            F.col("last.support").alias("support_price"),
            "bought_date",
            F.col("bought_shares").alias("total_shares"),
            safe_div(F.lit(trade.initial_cash) - cash_then, shares_then).alias("cost_price"),
            "trade_date",
            F.coalesce("last_sale.sold_day", F.lit(0)).alias("holding_days"),
            F.lit(trade.max_holding_days).alias("max_holding_days"),
            "current_cash",
            "current_positions",
            (F.col("current_positions") * F.col("last.last_close")).alias("market_value"),
        )
    )


def _counted(sale: str, part: str):
    return F.when(F.col(f"{sale}_counts"), F.col(f"{sale}_{part}"))


def pnl_rows(ledger: DataFrame) -> DataFrame:
    """Per (code, name): the position's worth with its cash, profit, profit ratio and whether it is a profit."""
    grouped = ledger.filter(F.col(KEY).isNotNull() & F.col("stock_name").isNotNull()).groupBy(KEY, "stock_name").agg(
        F.min("bought_date").alias("bought_date"),
        *(F.max(c).alias(c) for c in (
            "init_cash", "total_shares", "cost_price", "trade_date", "holding_days", "max_holding_days",
        )),
        (F.sum("market_value") + F.sum("current_cash")).alias("market_value"),
    )
    return grouped.withColumn("profit", F.col("market_value") - F.col("init_cash")).withColumns({
        "profit_percent": F.col("profit") / F.col("init_cash"),
        "is_profit": F.col("profit") > 0,
    })


def pnl_total(rows: DataFrame) -> DataFrame:
    """The total row: sums of cash and worth, with their difference and ratio."""
    total = rows.agg(F.sum("init_cash").alias("init_cash"), F.sum("market_value").alias("market_value"))
    return total.withColumn("profit", F.col("market_value") - F.col("init_cash")).withColumns({
        "stock_name": F.lit(TOTAL_LABEL),
        "profit_percent": safe_div(F.col("profit"), F.col("init_cash")),
    })


def pnl_report(ledger: DataFrame) -> DataFrame:
    """Numbered per-stock rows followed by the total row, which has no number."""
    numbered = number_rows(pnl_rows(ledger), [KEY, "stock_name"], "no")
    columns = [*REPORT_NAMES, "is_profit"]
    return numbered.select(*columns).unionByName(pnl_total(numbered), allowMissingColumns=True).select(*columns)
