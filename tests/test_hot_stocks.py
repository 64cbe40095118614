"""The split path must give what the usual one gives."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from candlemill.operators import keyed

from candlemill.operators.keyed import by_size, find_hot, nearest, number_rows, with_nearest
from candlemill.operators.prices import adjusted_bars
from candlemill.operators.screen import breakout_screen, signals
from candlemill.operators.support import find_dips, number_bars, support_window_bars
from candlemill.operators.thinning import drop_consecutive_higher
from candlemill.operators.windows import rolling_stats
from candlemill.plans.screen import run_screen
from candlemill.sources.shared import keep
from fixtures.market import SCREEN, TRADE


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_find_hot(market):
    sizes = {r[0]: r[1] for r in market.bars.groupBy("stock_code").count().collect()}
    limit = sorted(sizes.values())[len(sizes) // 2]
    found = {r[0] for r in find_hot(market.bars, limit).collect()}
    assert found == {c for c, n in sizes.items() if n > limit}
    assert find_hot(market.bars, max(sizes.values())) is None


def test_by_size(market):
    sizes = sorted(r[1] for r in market.bars.groupBy("stock_code").count().collect())
    hot = find_hot(market.bars, sizes[4])
    split = by_size(market.bars, hot, lambda rows, split: adjusted_bars(rows, split).withColumn("split", F.lit(split)))
    assert rows(split.drop("split")) == rows(adjusted_bars(market.bars).select(*split.drop("split").columns))
    codes = {r[0] for r in hot.collect()}
    assert 0 < len(codes) < 10
    assert all((r.stock_code in codes) == r.split for r in split.select("stock_code", "split").distinct().collect())


def test_number_rows(market):
    numbered = number_rows(market.bars.select("stock_code", "trade_date").distinct(), ["stock_code", "trade_date"], "no")
    listed = sorted((r.no, r.stock_code, r.trade_date) for r in numbered.collect())
    assert [n for n, *_ in listed] == list(range(1, len(listed) + 1))
    assert listed == sorted(listed, key=lambda r: r[1:])


def test_prices(market):
    usual, split = adjusted_bars(market.bars), adjusted_bars(market.bars, split=True)
    names = sorted(usual.columns)
    both = [rows(d.select(*names)) for d in (usual, split)]
    assert both[0] == both[1]


def test_many_versions_give_equal_values(market):
    """Unrounded: a signal must not depend on how many rows a stock has."""
    version = F.col("version_no")
    bars = market.bars.withColumn("version_no", F.explode(F.array(*map(F.lit, range(3)))))
    bars = bars.withColumn("close_price", F.col("close_price") * (1 + version * 1e-3)).drop("version_no")
    usual, split = adjusted_bars(bars), adjusted_bars(bars, split=True)
    assert rows(usual) == rows(split.select(*usual.columns))
    assert rows(run_screen(bars, market.finance, SCREEN, 1)) == rows(run_screen(bars, market.finance, SCREEN, 10**9))


@pytest.mark.parametrize("segment_rows", [1, 40, 64, 100_000])
def test_windows(market, segment_rows):
    adjusted = keep(market.adjusted(), "adjusted")
    names = ("max_close", "max_high", "min_low", "first_open")
    usual = rolling_stats(adjusted, SCREEN, with_support_date=True)
    split = rolling_stats(adjusted, SCREEN, split=True, with_support_date=True, segment_rows=segment_rows)
    picked = ("stock_code", "trade_date", "rn", "has_gain", "max_close_date", *names)
    assert rows(usual.select(*picked)) == rows(split.select(*picked))


@pytest.mark.parametrize("bars", [1, 2, 7, 40, 400])
def test_rolling_blocks_are_sliding_frames(market, monkeypatch, bars):
    """Statistics from growing frames over blocks are those of a sliding frame, however many bars it looks back."""
    adjusted = keep(market.adjusted(), "adjusted").withColumn("adj_low", F.when(F.hash("trade_date") % 3 != 0, F.col("adj_low")))
    params = replace(SCREEN, history_bars=bars)
    found = {}
    for limit in (0, 10**6):
        monkeypatch.setattr(keyed, "SLIDING_ROWS", limit)
        names = ("stock_code", "trade_date", "rn", "has_gain", "max_close_date", "max_close", "max_high", "min_low", "first_open")
        found[limit] = [rows(rolling_stats(adjusted, params, split, True, segment_rows=64).select(*names)) for split in (False, True)]
    assert found[0][0] == found[0][1] == found[10**6][0] == found[10**6][1]


def test_versions_of_a_date(spark):
    """Several versions of one date share their factor and are numbered in a fixed order on both paths."""
    from datetime import date, timedelta

    data = [
        ("sz000001", f"n{v}", date(2024, 1, 1) + timedelta(days=d), 1.0 + v, 10.0 + d + v, 12.0 + d, 9.0 - v,
         9.5 + d, 1e9, 2e9, "a", "b", "c")
        for d in range(30) for v in range(3)
    ]
    from candlemill.operators.prices import BAR_COLUMNS
    from dataclasses import replace
    from datetime import datetime

    bars = spark.createDataFrame(data * 2, list(BAR_COLUMNS))
    params = replace(SCREEN, earliest=datetime(2024, 1, 5), history_bars=4)
    out = [
        rows(rolling_stats(adjusted_bars(bars, split), params, split, True, segment_rows=5).select(
            "stock_name", "trade_date", "rn", "max_close_date", "has_gain", "max_close", "min_low", "factor"))
        for split in (False, True)
    ]
    assert len(out[0]) == 26 * 3
    assert out[0] == out[1]


def test_signals_and_thinning(market):
    screened = keep(breakout_screen(market.stats(), SCREEN), "screened")
    usual, split = signals(screened, market.finance, SCREEN), signals(screened, market.finance, SCREEN, split=True)
    assert rows(usual) == rows(split)
    assert rows(drop_consecutive_higher(usual)) == rows(drop_consecutive_higher(split, split=True, segment_rows=1))


def test_positions_and_dips(market):
    stats = keep(market.stats(with_support_date=True), "stats")
    limited = support_window_bars(stats, SCREEN, TRADE)
    assert rows(limited) == rows(support_window_bars(stats, SCREEN, TRADE, split=True))
    usual, split = number_bars(limited), number_bars(limited, split=True, segment_rows=3)
    assert rows(usual.select("stock_code", "rn", "pos")) == rows(split.select("stock_code", "rn", "pos"))
    assert rows(find_dips(usual, market.targets, TRADE)) == rows(find_dips(split, market.targets, TRADE))


def test_nearest_by_brute_force(spark):
    import random
    from datetime import date, timedelta

    random.seed(5)
    day = lambda: date(2024, 1, 1) + timedelta(days=random.randrange(60))
    left = [(random.choice("ab"), day()) for _ in range(40)]
    right = [(random.choice("ab"), d, (d - date(2024, 1, 1)).days) for d in (day() for _ in range(15))]
    points = spark.createDataFrame(left, "stock_code string, at date")
    values = spark.createDataFrame(right, "stock_code string, on date, v int")
    back = {(c, d): max((v for k, o, v in right if k == c and o <= d), default=None) for c, d in left}
    ahead = {(c, d): min((v for k, o, v in right if k == c and o > d), default=None) for c, d in left}
    assert {(r[0], r[1]): r[2] for r in nearest(points, values, ("at", "on"), "v").collect()} == back
    assert {(r[0], r[1]): r[2] for r in nearest(points, values, ("at", "on"), "v", forward=True).collect()} == ahead
    for split in (False, True):
        found = with_nearest(points, values, ("at", "on"), "v", split).select("stock_code", "at", "v").collect()
        assert sorted(map(tuple, found), key=repr) == sorted(((c, d, back[c, d]) for c, d in left), key=repr)
