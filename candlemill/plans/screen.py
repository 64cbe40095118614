"""The screen from bars and statements to thinned signals."""

from __future__ import annotations

from pyspark.sql import DataFrame

from candlemill.operators.keyed import HOT_ROWS, by_size, find_hot, tasks_for
from candlemill.operators.prices import adjusted_bars
from candlemill.operators.screen import breakout_screen, signals
from candlemill.operators.thinning import apply_thinning
from candlemill.operators.windows import rolling_stats
from candlemill.params import ScreenParams


def run_stats(
    bars: DataFrame, params: ScreenParams, with_support_date: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Rolling statistics of all bars."""
    tasks = tasks_for(bars)
    return by_size(
        bars, find_hot(bars, hot_rows),
        lambda rows, split: rolling_stats(adjusted_bars(rows, split, tasks=tasks), params, split, with_support_date),
    )


def run_signals(bars: DataFrame, finance: DataFrame, params: ScreenParams, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All signals."""
    tasks = tasks_for(bars)
    return by_size(bars, find_hot(bars, hot_rows), lambda rows, split: _signals(rows, finance, params, split, tasks))


def run_screen(bars: DataFrame, finance: DataFrame, params: ScreenParams, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The signals the thinning rule leaves."""
    tasks = tasks_for(bars)
    return by_size(
        bars, find_hot(bars, hot_rows),
        lambda rows, split: apply_thinning(_signals(rows, finance, params, split, tasks), params, split),
    )


def _signals(bars: DataFrame, finance: DataFrame, params: ScreenParams, split: bool, tasks: int) -> DataFrame:
    stats = rolling_stats(adjusted_bars(bars, split, tasks=tasks), params, split)
    return signals(breakout_screen(stats, params), finance, params, split)
