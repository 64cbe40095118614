"""Jobs on a target list: pullbacks to support, and the trades with their report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from candlemill.operators.keyed import HOT_ROWS, KEY, by_size, find_hot, tasks_for
from candlemill.operators.prices import adjusted_bars
from candlemill.operators.report import pnl_report, position_ledger
from candlemill.operators.support import find_dips, number_bars, support_window_bars
from candlemill.operators.trades import apply_exit_rules, size_entries
from candlemill.operators.windows import rolling_stats
from candlemill.params import ScreenParams, TradeParams
from candlemill.sources.shared import keep


def limited_bars(
    bars: DataFrame, targets: DataFrame, params: ScreenParams, trade: TradeParams, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Numbered support-window bars of the target stocks, written because both jobs look into them several times."""
    chosen = bars.join(targets.select(KEY).distinct(), KEY, "left_semi")
    tasks = tasks_for(bars)

    def chain(rows: DataFrame, split: bool) -> DataFrame:
        stats = rolling_stats(adjusted_bars(rows, split, tasks=tasks), params, split, with_support_date=True)
        return number_bars(support_window_bars(stats, params, trade, split), split)

    return keep(by_size(chosen, find_hot(chosen, hot_rows), chain), "limited")


def run_support_windows(
    bars: DataFrame, params: ScreenParams, trade: TradeParams, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Bars in the support windows of all signals."""
    tasks = tasks_for(bars)

    def chain(rows: DataFrame, split: bool) -> DataFrame:
        stats = rolling_stats(adjusted_bars(rows, split, tasks=tasks), params, split, with_support_date=True)
        return support_window_bars(stats, params, trade, split)

    return by_size(bars, find_hot(bars, hot_rows), chain)


def run_dips(
    bars: DataFrame, targets: DataFrame, params: ScreenParams, trade: TradeParams, hot_rows: int = HOT_ROWS
) -> DataFrame:
    return find_dips(limited_bars(bars, targets, params, trade, hot_rows), targets, trade)


def run_trades(
    bars: DataFrame, targets: DataFrame, params: ScreenParams, trade: TradeParams, hot_rows: int = HOT_ROWS
) -> DataFrame:
    numbered = limited_bars(bars, targets, params, trade, hot_rows)
    positions = apply_exit_rules(size_entries(numbered, targets, trade), numbered, trade)
    return pnl_report(position_ledger(positions, trade))
