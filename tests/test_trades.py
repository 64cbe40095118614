"""Entry, exit rules, ledger and report: literal cases, and the whole chain against a plain loop over targets."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from candlemill import TradeParams
from candlemill.operators.report import TOTAL_LABEL, pnl_report, position_ledger
from candlemill.operators.trades import apply_exit_rules, size_entries
from candlemill.sources.sinks import display_report

TRADE = TradeParams()
DAY = date(2024, 1, 1)
BARS = ("stock_code string, trade_date date, pos long, adj_support_price double, adj_open double, adj_high double, "
        "adj_low double, adj_close double")
TARGETS = "stock_code string, stock_name string, breakthrough_date date, list_pos long"


def flat(price=10.0, n=3):
    """(open, high, low, close) of n bars."""
    return [(price, price, price, price)] * n


def frames(spark, bars, targets, support=1.0):
    rows = [
        (code, DAY + timedelta(days=i), i + 1, support, *map(float, prices))
        for code, listed in bars.items() for i, prices in enumerate(listed)
    ]
    return spark.createDataFrame(rows, BARS), spark.createDataFrame(targets, TARGETS)


def trade(spark, listed, support=1.0):
    """One target whose breakthrough is the first bar; the given bars follow it."""
    bars, targets = frames(spark, {"a": flat(n=1) + listed}, [("a", "n", DAY, 1)], support)
    positions = apply_exit_rules(size_entries(bars, targets, TRADE), bars, TRADE)
    return positions.first(), position_ledger(positions, TRADE).first()


def test_lots(spark):
    position, _ = trade(spark, [(12.34, 12.5, 12.34, 12.5)])
    assert (position.shares_at_open, position.shares_at_close, position.total_shares) == (4000.0, 4000.0, 8000.0)


def test_too_dear(spark):
    position, ledger = trade(spark, flat(600.0))
    assert position.total_shares == 0 and position.exit_day is None and position.cost_price is None
    assert (ledger.total_shares, ledger.current_cash, ledger.market_value) == (0.0, 100_000.0, 0.0)
    assert ledger.cost_price is None and ledger.trade_date is None and ledger.holding_days == 0


def test_stop_on_the_first_day_keeps_the_shares(spark):
    position, ledger = trade(spark, [(10.0, 10.0, 9.0, 9.8), *flat(20.0)])
    assert (position.exit_day, position.exit_price) == (1, pytest.approx(position.cost_price * 0.95))
    assert ledger.current_positions == position.total_shares
    assert ledger.market_value == pytest.approx(position.total_shares * 9.8)
    assert ledger.trade_date is None


def test_half_sale_and_one_rung(spark):
    position, ledger = trade(spark, [*flat(n=1), (10, 11.2, 10, 11.1), (11.1, 13.5, 11.1, 11.9), (12, 12, 12, 12)])
    assert (position.half_day, position.half_price, position.half_shares) == (2, 11.0, position.total_shares / 2)
    # 13.5 is 1.35 times the cost, yet only the rung 1.20 is reached; the close is below it.
    assert (position.exit_day, position.exit_price) == (3, 12.0)
    assert ledger.current_positions == 0 and ledger.holding_days == 3


def test_close_below_the_first_rung(spark):
    position, _ = trade(spark, [*flat(n=1), (10, 11.2, 10, 10.9), *flat(11.5)])
    assert (position.half_day, position.exit_day, position.exit_price) == (2, 2, 11.0)


def test_double(spark):
    position, _ = trade(spark, [*flat(n=1), (10, 11.2, 10, 11.2), (11.2, 20.0, 11.2, 15), *flat(15)])
    assert (position.exit_day, position.exit_price) == (3, 20.0)


def test_fourth_close_below_support(spark):
    weak = (9.8, 9.8, 9.7, 9.8)
    position, _ = trade(spark, [*flat(n=1), *[weak] * 3, (9.9, 10, 9.7, 9.95), *[weak] * 6], support=9.9)
    assert (position.exit_day, position.exit_price) == (9, 9.8)


def test_day_forty(spark):
    position, ledger = trade(spark, [*flat(n=39), (10, 10, 10, 10.2), (10, 10, 10, 10.4), *flat(n=4)])
    assert (position.exit_day, position.exit_date, position.exit_price) == (40, DAY + timedelta(days=40), 10.2)
    assert position.exit_bar_close == 10.4 and ledger.holding_days == 40


def test_last_bar(spark):
    position, _ = trade(spark, [*flat(n=4), (10, 10, 10, 10.3)])
    assert (position.exit_day, position.exit_price) == (5, 10.3)


def test_no_bar_after_the_breakthrough(spark):
    bars, targets = frames(spark, {"a": flat()}, [("a", "n", DAY + timedelta(days=2), 1), ("b", "n", DAY, 2)])
    assert size_entries(bars, targets, TRADE).count() == 0


def follow(bars, start, support):
    """Sales of one position as (day, date, shares, price, close of the bar)."""
    o, _, _, c = bars[start]
    lots = lambda p: 50_000.0 / p // 100 * 100
    shares = lots(o) + lots(c)
    if not shares:
        return shares, lots(o), lots(c), []
    cost = (lots(o) * o + lots(c) * c) / shares
    stop, top, half, weak, left, sales = cost * 0.95, 1.0, False, 0, shares, []
    for day, i in enumerate(range(start, len(bars)), 1):
        _, high, low, close = bars[i]
        sale = lambda price, n=None, at=i, d=day: sales.append((d, at, left if n is None else n, price, close))
        if day == 41:
            sale(bars[i - 1][3], at=i - 1, d=40)
            break
        if low < stop:
            sale(stop)
            break
        weak = weak + 1 if low < support and close < support else 0
        if weak == 4:
            sale(close)
            break
        rise = high / cost
        if not half and rise >= 1.1:
            sale(cost * 1.1, left * 0.5)
            left, half, stop, top = left * 0.5, True, cost * 1.1, 1.1
        if half:
            if rise > top:
                nearest_rung = [r for r in (1.2, 1.3, 1.4, 1.5, 1.6, 1.7, 1.8, 1.9) if r > top][:1]
                if nearest_rung and rise >= nearest_rung[0]:
                    top, stop = nearest_rung[0], cost * nearest_rung[0]
                if rise >= 2.0:
                    sale(cost * 2.0)
                    break
            if close < stop:
                sale(stop)
                break
            if top >= rise and day >= 40:
                sale(close)
                break
        if i == len(bars) - 1:
            sale(close)
    return shares, lots(o), lots(c), sales


def plain_ledger(bars, targets, support):
    ledger = {}
    for code, name, day, _ in sorted(targets, key=lambda t: t[3]):
        start = next((i for i in range(len(bars[code])) if DAY + timedelta(days=i) > day), None)
        if start is None:
            continue
        _, at_open, at_close, sales = follow(bars[code], start, support)
        o, _, _, c = bars[code][start]
        row = ledger.setdefault(code, {"cash": 100_000.0, "held": 0.0, "bought": DAY + timedelta(days=start), "total": 0.0,
                                       "days": 0, "sold": None})
        row["bought"] = min(row["bought"], DAY + timedelta(days=start))
        row["cash"] -= at_open * o + at_close * c
        row["held"] += at_open + at_close
        row["total"] += at_open + at_close
        row["cost"] = (100_000.0 - row["cash"]) / row["held"] if row["held"] else None
        row["value"], row["name"] = row["held"] * c, name
        for holding, at, n, price, close in sales:
            if holding > 1:
                row["cash"] += n * price
                row["held"] -= n
                row["value"], row["days"] = row["held"] * close, holding
                row["sold"] = max(filter(None, (row["sold"], DAY + timedelta(days=at))))
    return ledger


@pytest.mark.parametrize("seed", range(4))
def test_chain_by_loop(spark, seed):
    rng = random.Random(seed)
    bars, targets = {}, []
    for code in (f"s{i}" for i in range(25)):
        price, listed = rng.uniform(4, 60) if rng.random() < 0.9 else 900.0, []
        drift = rng.choice((-0.01, 0.0, 0.005, 0.03))
        for _ in range(rng.randrange(1, 90)):
            o = price * math.exp(rng.gauss(0, 0.01))
            price *= math.exp(rng.gauss(drift, 0.03))
            high, low = max(o, price) * (1 + abs(rng.gauss(0, 0.03))), min(o, price) * (1 - abs(rng.gauss(0, 0.01)))
            listed.append(tuple(round(x, 2) for x in (o, high, low, price)))
        bars[code] = listed
        for _ in range(rng.randrange(1, 6)):
            targets.append((code, f"n{rng.randrange(3)}", DAY + timedelta(days=rng.randrange(90)), len(targets)))
    rng.shuffle(targets)
    limited, listed = frames(spark, bars, targets, support=12.0)
    found = position_ledger(apply_exit_rules(size_entries(limited, listed, TRADE), limited, TRADE), TRADE)
    expected = plain_ledger(bars, targets, 12.0)
    rows = {r.stock_code: r for r in found.collect()}
    assert rows.keys() == expected.keys() and len(rows) > 10
    for code, e in expected.items():
        r = rows[code]
        assert (r.stock_name, r.bought_date, r.trade_date, r.holding_days) == (e["name"], e["bought"], e["sold"], e["days"]), code
        assert (r.total_shares, r.current_positions) == (e["total"], e["held"])
        assert r.current_cash == pytest.approx(e["cash"]) and r.market_value == pytest.approx(e["value"])
        assert r.cost_price == (None if e["cost"] is None else pytest.approx(e["cost"]))


def test_report(spark):
    bars, targets = frames(spark, {"a": flat(n=1) + [(10, 10, 10, 10.0), (10, 10, 10, 10.5)], "b": flat(n=1) + flat(600.0)},
                           [("a", "x", DAY, 1), ("a", "y", DAY, 2), ("b", "z", DAY, 3)])
    positions = apply_exit_rules(size_entries(bars, targets, TRADE), bars, TRADE)
    rows = pnl_report(position_ledger(positions, TRADE)).orderBy(F.col("no").asc_nulls_last()).collect()
    assert [(r.no, r.stock_code, r.stock_name, r.is_profit) for r in rows] == [
        (1, "a", "y", True), (2, "b", "z", False), (None, None, TOTAL_LABEL, None)]
    assert [r.market_value for r in rows] == pytest.approx([110_000.0, 100_000.0, 210_000.0])
    assert [r.profit_percent for r in rows] == pytest.approx([0.1, 0.0, 0.05])
    assert rows[0].total_shares == 20_000.0
    shown = display_report(pnl_report(position_ledger(positions, TRADE)))
    assert shown.columns[0] == "编号" and shown.filter("`编号` is null").first()["最大持有天数"] == "总市值"
