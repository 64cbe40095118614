"""Support windows and dips."""

import random
from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest

from candlemill import ScreenParams, TradeParams
from candlemill.operators.support import find_dips, support_window_bars

PARAMS = ScreenParams(earliest=datetime(2020, 1, 1), history_bars=2)
LONG = replace(PARAMS, history_bars=15)
TRADE = TradeParams()
STATS = ("stock_code string, stock_name string, trade_date date, version long, rn long, adj_close double, adj_high double, "
         "adj_low double, adj_open double, max_close double, max_close_date date, max_high double, min_low double, "
         "first_open double, float_cap double, has_gain int, industry_level2 string, industry_level3 string")
NUMBERED = ("stock_code string, trade_date date, pos long, adj_support_price double, adj_support_date date, "
            "adj_high double, adj_low double, adj_close double")
DAY = date(2024, 1, 1)


def stats(spark, days, signals):
    """Flat bars on `days`; `signals` maps a day to its support day."""
    rows = [
        ("sh900001", "n", d, 0, 20 + i, 20.0 if d in signals else 10.0, 10.0, 10.0, 10.0, 10.0, signals.get(d, d),
         10.0, 10.0, 10.0, 100.0, 0, "b", "c")
        for i, d in enumerate(days)
    ]
    return spark.createDataFrame(rows, STATS)


def test_window_length(spark):
    days = [DAY + timedelta(days=d) for d in range(-5, 60)]
    found = support_window_bars(stats(spark, days, {DAY + timedelta(days=9): DAY}), LONG, TRADE).collect()
    kept = sorted(r.trade_date for r in found)
    assert (kept[0], kept[-1], len(kept)) == (DAY, date(2024, 2, 11), 42)


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("holding", [0, 1, 6, 40])
def test_windows_by_loop(spark, holding, split):
    rng = random.Random(holding)
    days = sorted(DAY + timedelta(days=d) for d in rng.sample(range(900), 300))
    signals = {}
    for i in rng.sample(range(20, 300), 12):
        signals[days[i]] = days[i - rng.randrange(1, 15)]
    trade = replace(TRADE, window_holding_days=holding)
    found = support_window_bars(stats(spark, days, signals), LONG, trade, split).collect()
    length = timedelta(days=holding + 1)
    assert sorted(r.trade_date for r in found) == [d for d in days if any(s <= d <= s + length for s in signals.values())]
    assert TradeParams(window_holding_days=None).days_limit == 41


def bars(spark, rows):
    return spark.createDataFrame(
        [("a", DAY + timedelta(days=i), i + 1, s, DAY, *map(float, prices)) for i, (s, *prices) in enumerate(rows)], NUMBERED)


def targets(spark, *days):
    return spark.createDataFrame([("a", "n", DAY + timedelta(days=d)) for d in days],
                                 "stock_code string, stock_name string, breakthrough_date date")


def test_first_bar_after_is_left_out(spark):
    dip = (9.0, 10.5, 9.9, 10.2)
    found = find_dips(bars(spark, [(10.0, 11, 11, 11), dip, dip]), targets(spark, 0), TRADE).collect()
    assert [(r.dip_date, r.support_price, r.support_date) for r in found] == [(DAY + timedelta(days=2), 10.0, DAY)]


@pytest.mark.parametrize("bar,ok", [
    ((9.0, 10.5, 10.05, 10.2), True), ((9.0, 10.5, 10.06, 10.2), False), ((9.0, 10.5, 9.0, 10.0), False),
    ((9.0, 9.99, 9.0, 10.2), False), ((9.0, 10.5, -3.0, 10.01), True),
])
def test_dip_conditions(spark, bar, ok):
    found = find_dips(bars(spark, [(10.0, 11, 11, 11), bar, bar]), targets(spark, 0), TRADE)
    assert found.count() == int(ok)


@pytest.mark.parametrize("support", [None, 0.0])
def test_no_support_price(spark, support):
    bar = (9.0, 10.5, -1.0, 10.2)
    assert find_dips(bars(spark, [(support, 11, 11, 11), bar, bar]), targets(spark, 0, 7), TRADE).count() == 0


def test_dips_by_loop(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(200):
        low = round(rng.uniform(2, 40), 2)
        rows.append((round(rng.uniform(2, 40), 2), round(low * rng.uniform(1, 3), 2), low, round(low * rng.uniform(1, 2), 2)))
    days = [rng.randrange(220) for _ in range(60)]
    expected = sorted(
        (d, i) for d in days if d < 200 for i in range(d + 2, 200)
        if rows[i][1] >= rows[d][0] and rows[i][2] * 0.995 <= rows[d][0] < rows[i][3]
    )
    found = find_dips(bars(spark, rows), targets(spark, *days), TRADE).collect()
    assert len(expected) > 500
    assert sorted(((r.breakthrough_date - DAY).days, (r.dip_date - DAY).days) for r in found) == expected
