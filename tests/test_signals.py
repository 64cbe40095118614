"""Literal cases for statements and thinning, and the thinning rules against plain loops."""

import random
from datetime import date, datetime, timedelta

import pandas as pd
import pytest

from candlemill import ScreenParams
from candlemill.operators.finance import distinct_statements, finance_asof, finance_yoy
from candlemill.operators.thinning import apply_thinning, drop_consecutive_higher, thin_signals

PARAMS = ScreenParams(earliest=datetime(2022, 1, 1))
FINANCE = "stock_code string, report_date string, R_np double, R_operating_total_revenue double"
SIGNAL = "stock_code string, trade_date date, adj_close double"
MONDAY = date(2024, 1, 1)


def growth(spark, statements, days, params=PARAMS):
    screened = spark.createDataFrame([("a", d) for d in days], "stock_code string, trade_date date")
    finance = spark.createDataFrame([("a", *s) for s in statements], FINANCE)
    return finance_yoy(screened, finance, params).orderBy("trade_date", "latest_net_profit").collect()


def test_asof(spark):
    screened = spark.createDataFrame(
        [("a", date(2024, 6, 29)), ("a", date(2024, 6, 30)), ("b", date(2024, 6, 30))], "stock_code string, trade_date date")
    finance = spark.createDataFrame([("a", "20240331", 1.0, 1.0), ("a", "20240630", 1.0, 1.0)], FINANCE)
    found = finance_asof(screened, distinct_statements(finance, PARAMS)).collect()
    assert {(r.stock_code, r.trade_date.day): r.latest_report_date for r in found} == {
        ("a", 29): "20240331", ("a", 30): "20240630", ("b", 30): None}


@pytest.mark.parametrize("base,latest,expected", [(0.0, 5.0, None), (None, 5.0, None), (-100.0, 50.0, -150.0), (80.0, 100.0, 25.0)])
def test_growth(spark, base, latest, expected):
    rows = growth(spark, [("20230331", base, 1.0), ("20240331", latest, 1.5)], [date(2024, 5, 1)])
    assert [(r.net_profit_yoy, r.revenue_yoy) for r in rows] == [(expected, 50.0)]


def test_year_ago_before_the_bound(spark):
    params = ScreenParams(earliest=datetime(2024, 1, 1))
    row = growth(spark, [("20230331", 1.0, 1.0), ("20240331", 2.0, 2.0)], [date(2024, 5, 1)], params)[0]
    assert (row.latest_report_date, row.last_year_report_date, row.net_profit_yoy) == ("20240331", "20230331", None)


def test_versions_of_a_statement_fan_out(spark):
    rows = growth(spark, [("20240331", 1.0, 1.0), ("20240331", 2.0, 1.0), ("20240331", 2.0, 1.0)], [date(2024, 5, 1)])
    assert [r.latest_net_profit for r in rows] == [1.0, 2.0]


def weekdays_after(a, b):
    """Weekdays from a to b, both counted, less one."""
    return sum((a + timedelta(days=n)).weekday() < 5 for n in range((b - a).days + 1)) - 1


def plain_thin(days, range_days):
    """Dates kept: the first one, and every anchor that no row follows within its range.

    The first row is an anchor, and so is the first row out of reach of the anchor before.
    """
    anchors = [0]
    while reach := [i for i in range(anchors[-1], len(days)) if weekdays_after(days[anchors[-1]], days[i]) > range_days]:
        anchors.append(reach[0])
    ends = {*anchors, len(days)}
    return [days[i] for i in sorted({0, *(i for i in anchors if i + 1 in ends)})]


def test_rule_1_1(spark):
    rows = [("a", MONDAY, 10.0), ("a", MONDAY + timedelta(days=1), 10.5), ("a", MONDAY + timedelta(days=2), 10.2)]
    found = drop_consecutive_higher(spark.createDataFrame(rows, SIGNAL)).collect()
    assert sorted(r.adj_close for r in found) == [10.0, 10.2]
    # A dropped signal still counts as the previous one.
    rows[2] = ("a", MONDAY + timedelta(days=2), 10.6)
    assert [r.adj_close for r in drop_consecutive_higher(spark.createDataFrame(rows, SIGNAL)).collect()] == [10.0]


def test_rule_1_2(spark):
    days = [d.date() for d in pd.bdate_range(MONDAY, periods=21)]
    rows = [("a", days[i], float(i)) for i in (0, 3, 10, 12, 20)]
    found = thin_signals(spark.createDataFrame(rows, SIGNAL), 5).collect()
    assert sorted(r.adj_close for r in found) == [0.0, 20.0]


@pytest.mark.parametrize("seed", range(3))
def test_rule_1_2_by_loop(spark, seed):
    rng = random.Random(seed)
    rows, expected = [], []
    for code in "abcde":
        days = sorted(MONDAY + timedelta(days=rng.randrange(250)) for _ in range(rng.randrange(1, 40)))
        rows += [(code, d, float(i)) for i, d in enumerate(days)]
        expected += [(code, d) for d in plain_thin(days, 5)]
    found = thin_signals(spark.createDataFrame(rows, SIGNAL), 5).collect()
    assert sorted((r.stock_code, r.trade_date) for r in found) == sorted(expected)


def test_rule_choice(spark):
    signals = spark.createDataFrame([("a", MONDAY, 10.0), ("a", MONDAY + timedelta(days=1), 9.0)], SIGNAL)
    assert apply_thinning(signals, ScreenParams(thinning="1.1")).count() == 2
    assert apply_thinning(signals, ScreenParams(thinning="1.2")).count() == 1


@pytest.mark.parametrize("text", ["2025-06-30", "1", ""])
def test_a_report_date_that_is_no_date_raises(spark, text):
    with pytest.raises(Exception, match="CANNOT_PARSE|DateTime|could not be parsed|CAST_INVALID"):
        growth(spark, [(text, 1.0, 1.0)], [date(2025, 7, 1)])
