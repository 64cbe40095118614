"""Shapes of the physical plans, and the complete jobs with every stock taken for a hot one."""

import re
from dataclasses import replace

import pytest

from candlemill.operators import keyed
from candlemill.operators.prices import adjusted_bars, drilldown
from candlemill.operators.screen import breakout_screen, signals
from candlemill.operators.support import support_window_bars
from candlemill.operators.windows import rolling_stats
from candlemill.plans.evaluate import run_dips, run_support_windows, run_trades
from candlemill.plans.screen import run_screen, run_signals, run_stats
from fixtures.market import SCREEN, TRADE, Market
from fixtures.registry import DRILL_CODE, DRILL_DAY, QUERIES

PYTHON_QUERIES = {"apply_exit_rules", "position_ledger"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(df, node):
    return plan(df).count(f"{node} ")


def test_prices_take_one_exchange(market):
    adjusted = adjusted_bars(market.bars)
    assert count(adjusted, "Exchange") == 1 and count(adjusted, "+- Sort") == 1
    stats = rolling_stats(adjusted, SCREEN, with_support_date=True)
    assert count(stats, "Exchange") == 1 and count(stats, "FileScan") == 1
    assert count(stats, "+- Sort") == 1
    # For long histories there is one order forward and one backward.
    long = rolling_stats(adjusted, replace(SCREEN, history_bars=400), with_support_date=True)
    assert count(long, "Exchange") == 1 and count(long, "FileScan") == 1 and count(long, "+- Sort") == 2
    limited = support_window_bars(stats, SCREEN, TRADE)
    assert count(limited, "Exchange") == 1 and count(limited, "FileScan") == 1 and "collect_set" not in plan(limited)


def test_frames_over_long_histories_only_grow(market):
    """A frame that slides over n rows is looked through anew for every row; that of lag() is one row."""
    text = plan(rolling_stats(adjusted_bars(market.bars), replace(SCREEN, history_bars=400), with_support_date=True))
    frames = set(re.findall(r"specifiedwindowframe\(RowFrame, ([^,]+), ([^)]+)", text))
    assert frames and all(first == "unboundedpreceding$()" or first == last for first, last in frames)


def test_screen_scans_statements_once(market):
    text = plan(signals(breakout_screen(rolling_stats(adjusted_bars(market.bars), SCREEN), SCREEN), market.finance, SCREEN))
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert sum("R_np" in line for line in scans) == 1 and len(scans) == 2
    assert text.count("Exchange hashpartitioning") <= 5 and "Join" not in text


def test_only_used_columns_are_read(market):
    text = plan(breakout_screen(rolling_stats(adjusted_bars(market.bars), SCREEN), SCREEN))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "turnover" not in scan and "volume" not in scan


def test_code_filter_reaches_the_scan(market):
    text = plan(drilldown(market.bars, DRILL_CODE, SCREEN.first_trade_date, DRILL_DAY))
    pushed = text[text.index("PushedFilters"):]
    assert "stock_code" in pushed[:300]
    # The date must not reach it: factors need the whole history.
    assert "1998" not in pushed[:300]


def test_signals_read_bars_once(market):
    found = signals(breakout_screen(rolling_stats(adjusted_bars(market.bars), SCREEN), SCREEN), market.finance, SCREEN)
    assert sum("close_price" in line for line in plan(found).splitlines() if "FileScan" in line) == 1


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.endswith("_job") and "rule" not in n])
def test_no_all_pairs_and_no_needless_python(market, name):
    text = plan(QUERIES[name](market.spark, market.folder))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    assert ("MapInArrow" in text) == (name in PYTHON_QUERIES)


def test_jobs_with_hot_stocks_only(market):
    def rows(df):
        return sorted(map(tuple, df.collect()), key=repr)

    for params in (SCREEN, replace(SCREEN, thinning="1.2", require_growth=True)):
        usual, split = (run_screen(market.bars, market.finance, params, n) for n in (10**9, 1))
        assert rows(usual) == rows(split)
    for job in (run_dips, run_trades):
        usual, split = (job(market.bars, market.targets, SCREEN, TRADE, n) for n in (10**9, 1))
        assert rows(usual) == rows(split)


def test_what_a_task_holds_does_not_grow(market, monkeypatch):
    """Tasks are counted by rows: more of them for more rows, and not put together again because the rows are narrow."""
    plain = sorted(map(tuple, run_stats(market.bars, SCREEN).collect()), key=repr)
    monkeypatch.setattr(keyed, "TASK_ROWS", 200)
    tasks = keyed.tasks_for(market.bars)
    assert tasks == -(-market.bars.count() // 200) > 8
    for df in (run_stats(market.bars, SCREEN), run_signals(market.bars, market.finance, SCREEN), run_support_windows(market.bars, SCREEN, TRADE), market.adjusted()):
        assert re.search(rf"hashpartitioning\(stock_code#\d+, {tasks}\)", plan(df))
    assert sorted(map(tuple, run_stats(market.bars, SCREEN).collect()), key=repr) == plain
    before = market.spark.conf.get("spark.sql.shuffle.partitions")
    anew = Market(market.spark, market.folder).bars
    assert len(anew.inputFiles()) > 8 and sorted(map(tuple, anew.collect()), key=repr) == sorted(map(tuple, market.bars.collect()), key=repr)
    assert market.spark.conf.get("spark.sql.shuffle.partitions") == before
