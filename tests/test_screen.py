"""Literal cases for prices, windows and the conditions of the screen."""

from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from candlemill import ScreenParams
from candlemill.functions import amplitude, business_day_gap, whole_lots
from candlemill.operators.lookups import bars_between, row_count, statements_between
from candlemill.operators.prices import BAR_COLUMNS, adjusted_bars, distinct_bars, drilldown
from candlemill.operators.screen import amplitude_ok, breakout_screen
from candlemill.operators.windows import rolling_stats

DAY = date(2024, 1, 1)
SCHEMA = ", ".join(
    f"{c} {'date' if c == 'trade_date' else 'double' if 'price' in c or 'cap' in c else 'string'}" for c in BAR_COLUMNS
)
PARAMS = ScreenParams(earliest=datetime(2024, 1, 1), history_bars=2)


def bar(code="sz000001", day=0, close=10.0, prev=10.0, open_=None, high=None, low=None, cap=1e10):
    return (code, "n", DAY + timedelta(days=day), open_ or close, close, high or close, low or close, prev, cap, cap,
            "a", "b", "c")


def frame(spark, bars):
    return spark.createDataFrame(bars, SCHEMA)


def test_split_is_adjusted(spark):
    rows = adjusted_bars(frame(spark, [bar(close=10.0), bar(day=1, close=5.0, prev=5.0)])).orderBy("trade_date").collect()
    assert [r.factor for r in rows] == [1.0, 1.0]
    assert [r.adj_close for r in rows] == [5.0, 5.0]


@pytest.mark.parametrize("first", [None, 0.0])
def test_leading_null(spark, first):
    bars = [bar(close=10.0, prev=first), bar(day=1, close=11.0, prev=10.0), bar(day=2, close=11.0, prev=11.0)]
    rows = adjusted_bars(frame(spark, bars)).orderBy("trade_date").collect()
    assert rows[0].factor is None and rows[0].adj_close is None
    assert rows[1].adj_close == pytest.approx(11.0) and rows[2].adj_close == pytest.approx(11.0)


def test_last_adjusted_close_is_the_close(spark, market):
    adjusted = market.adjusted()
    last = adjusted.groupBy("stock_code").agg(F.max_by(F.struct("close_price", "adj_close"), "trade_date").alias("x"))
    assert last.filter(F.abs(F.col("x.close_price") - F.col("x.adj_close")) > 1e-9).count() == 0


def test_non_positive_close_gives_null(spark):
    rows = adjusted_bars(frame(spark, [bar(close=10.0), bar(day=1, close=-1.0)])).orderBy("trade_date").collect()
    assert rows[0].factor == 1.0 and rows[1].factor == 1.0
    assert rows[1].adj_open == -1.0


def test_copies_and_broken_keys(spark):
    bars = frame(spark, [bar(), bar(), bar(code=None), (*bar()[:2], None, *bar()[3:])])
    assert distinct_bars(bars).count() == 1
    assert adjusted_bars(bars).count() == 1


def stats(spark, closes, n=2, **kwargs):
    bars = [bar(day=i, close=c, prev=c) for i, c in enumerate(closes)]
    # Constant factors make the adjusted close the last close; plain closes are put back for the window cases.
    adjusted = adjusted_bars(frame(spark, bars)).withColumn("adj_close", F.col("close_price"))
    return rolling_stats(adjusted, replace(PARAMS, history_bars=n), **kwargs).orderBy("trade_date").collect()


def test_frame_excludes_the_bar(spark):
    assert [r.max_close for r in stats(spark, [1.0, 2.0, 3.0, 4.0])] == [None, 1.0, 2.0, 3.0]


def test_first_date_of_equal_closes(spark):
    rows = stats(spark, [7.0, 7.0, 1.0], with_support_date=True)
    assert rows[2].max_close_date == DAY and rows[0].max_close_date is None


def test_gain_flag(spark):
    bars = [bar(day=0), bar(day=1, close=10.5, prev=10.0), *(bar(day=d, close=10.5, prev=10.5) for d in (2, 3, 4))]
    rows = rolling_stats(adjusted_bars(frame(spark, bars)), PARAMS).orderBy("trade_date").collect()
    assert [r.has_gain for r in rows] == [None, 0, 1, 1, 0]


def test_date_bound_comes_after_the_factor(spark):
    bars = [bar(day=0, close=10.0), bar(day=1, close=20.0, prev=10.0), bar(day=2, close=20.0, prev=20.0)]
    rows = rolling_stats(adjusted_bars(frame(spark, bars)), replace(PARAMS, earliest=datetime(2024, 1, 2))).collect()
    assert sorted((r.rn, round(r.factor, 6)) for r in rows) == [(1, 2.0), (2, 2.0)]


def test_excluded_exchange(spark):
    assert rolling_stats(adjusted_bars(frame(spark, [bar(code="bj430001")])), PARAMS).count() == 0


@pytest.mark.parametrize("code,percent,ok", [
    ("sz300001", 30.0, True), ("sh600001", 30.0, False), ("sh900001", 500.0, True), ("sz300001", 35.0, True),
    ("sz003001", 25.0, True), ("sz004001", 1000.0, True), ("SZ300001", 36.0, True),
])
def test_boards(spark, code, percent, ok):
    row = spark.createDataFrame([(code, 100.0 + percent, 100.0, 100.0)], "stock_code string, max_high double, min_low double, first_open double")
    assert row.select(amplitude_ok(ScreenParams())).first()[0] is ok


def test_amplitude_guard(spark):
    row = spark.range(1).select(amplitude(F.lit(2.0), F.lit(1.0), F.lit(0.0)), amplitude(F.lit(2.0), F.lit(1.0), F.lit(None).cast("double")))
    assert tuple(row.first()) == (999999.0, 999999.0)


def test_cap_band_and_optional_gain(spark):
    def one(cap, gain=1):
        return ("sz000001", 3, 12.0, 10.0, 10.0, 10.0, 10.0, cap, gain)

    rows = spark.createDataFrame(
        [one(30.0), one(500.0, 0), one(500.01), one(29.99)],
        "stock_code string, rn long, adj_close double, max_close double, max_high double, min_low double, "
        "first_open double, float_cap double, has_gain int",
    )
    assert sorted(r.float_cap for r in breakout_screen(rows, PARAMS).collect()) == [30.0, 500.0]
    assert [r.float_cap for r in breakout_screen(rows, replace(PARAMS, require_gain=True)).collect()] == [30.0]


def test_screen_needs_full_history_and_margin(spark):
    rows = spark.createDataFrame(
        [("sz000001", rn, close, 10.0, 10.0, 10.0, 10.0, 100.0, 1) for rn, close in ((2, 12.0), (3, 10.1), (3, 10.11))],
        "stock_code string, rn long, adj_close double, max_close double, max_high double, min_low double, "
        "first_open double, float_cap double, has_gain int",
    )
    assert [(r.rn, r.adj_close) for r in breakout_screen(rows, PARAMS).collect()] == [(3, 10.11)]


@pytest.mark.parametrize("start,end,gap", [
    ("2024-01-05", "2024-01-08", 1), ("2024-01-01", "2024-01-08", 5), ("2024-01-05", "2024-01-12", 5),
    ("2024-01-05", "2024-01-05", 0), ("2024-01-06", "2024-01-07", -1), ("2024-01-06", "2024-01-08", 0),
])
def test_business_days(spark, start, end, gap):
    row = spark.range(1).select(business_day_gap(F.lit(start).cast("date"), F.lit(end).cast("date")))
    assert row.first()[0] == gap


def test_whole_lots(spark):
    row = spark.range(1).select(*(whole_lots(50_000, F.lit(p)) for p in (12.34, 12.5, 600.0, 0.0)))
    assert tuple(row.first()) == (4000.0, 4000.0, 0.0, None)


def test_drilldown_in_any_case(spark):
    volume = F.lit(5.0).alias("volume")
    bars = frame(spark, [bar(day=d, close=10.0 + d, prev=9.0 + d) for d in range(3)]).select("*", volume)
    shown = drilldown(bars, "SZ000001", DAY, DAY + timedelta(days=1)).collect()
    assert [(r.trade_date, round(r.close, 6), r.volume) for r in shown] == [(DAY + timedelta(days=1), 11.0, 5.0)]
    assert drilldown(bars, "sz000001", DAY + timedelta(days=2), DAY).count() == 0


def test_lookups(spark):
    bars = frame(spark, [bar(day=d) for d in range(5)]).select("*", F.lit(1.0).alias("volume"))
    found = bars_between(bars, DAY + timedelta(days=1), DAY + timedelta(days=3)).collect()
    assert [r.trade_date.day for r in found] == [2, 3, 4]
    assert row_count(bars).first().n_rows == 5
    finance = spark.createDataFrame(
        [("a", d, 1.0, 2.0, 3.0) for d in ("20231231", "20230531", "20230601")],
        "stock_code string, report_date string, B_total_assets double, B_total_liab double, B_total_owner_equity double",
    )
    assert [r.report_date for r in statements_between(finance, "20230601", "20231231").collect()] == ["20230601", "20231231"]


def test_settings():
    params = ScreenParams.from_settings({
        "earliest_time_limit": "2025-06-01 00:00:00", "cond1_and_cond3": "60_30_40", "cond2": "0.06",
        "apply_cond2_or_not": "yes", "use_cond_1_1_or_cond_1_2": "1.2", "range_days_of_cond_1_2": "7",
    })
    assert params == ScreenParams(history_bars=60, main_amplitude=30.0, growth_amplitude=40.0, gain=0.06,
                                  require_gain=True, thinning="1.2", range_days=7)
    with pytest.raises(ValueError):
        ScreenParams.from_settings({"apply_cond5_or_not": "maybe"})
    with pytest.raises(ValueError):
        ScreenParams(thinning="1.3")
    assert ScreenParams(earliest=datetime(2024, 1, 1, 12)).first_report_date == date(2024, 1, 2)
