"""Properties that hold on the derived tables, and the folder of written tables."""

import pytest
from pyspark.sql import functions as F

from candlemill.operators.keyed import row_hash
from candlemill.operators.report import pnl_rows, position_ledger
from candlemill.operators.support import support_window_bars
from candlemill.operators.thinning import drop_consecutive_higher, thin_signals
from candlemill.operators.trades import apply_exit_rules, size_entries
from candlemill.plans.screen import run_signals
from candlemill.sources import shared
from fixtures.market import SCREEN, TRADE


def test_screened_bars_have_full_history(market):
    from candlemill.operators.screen import breakout_screen

    assert breakout_screen(market.stats(), SCREEN).filter(F.col("rn") <= SCREEN.history_bars).count() == 0


def test_thinning_only_removes(market):
    signals = run_signals(market.bars, market.finance, SCREEN)
    for thinned in (drop_consecutive_higher(signals), thin_signals(signals, SCREEN.range_days)):
        assert 0 < thinned.count() < signals.count()
        assert thinned.exceptAll(signals).count() == 0


def test_windows_hold_their_support_dates(market):
    from candlemill.operators.screen import breakout_screen

    stats = market.stats(with_support_date=True)
    starts = breakout_screen(stats, SCREEN).select("stock_code", F.col("max_close_date").alias("trade_date"))
    covered = support_window_bars(stats, SCREEN, TRADE).select("stock_code", "trade_date")
    assert starts.exceptAll(covered.distinct()).distinct().join(covered, ["stock_code", "trade_date"], "left_anti").count() == 0


def test_positions_add_up(market):
    entries = size_entries(market.limited, market.targets, TRADE)
    assert entries.filter(F.pmod("total_shares", F.lit(100.0)) != 0).count() == 0
    ledger = position_ledger(apply_exit_rules(entries, market.limited, TRADE), TRADE)
    worth = pnl_rows(ledger).join(ledger.select("stock_code", "current_cash", F.col("market_value").alias("held")), "stock_code")
    assert worth.filter(F.abs(F.col("market_value") - F.col("held") - F.col("current_cash")) > 1e-6).count() == 0
    assert ledger.filter((F.col("current_positions") == 0) & (F.col("market_value") != 0)).count() == 0


def test_row_hash_tells_nulls_apart(spark):
    rows = spark.createDataFrame([(1.0, None), (None, 1.0)], "a double, b double")
    assert rows.select(row_hash(rows)).distinct().count() == 2


def test_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: f"{tmp_path}/" if key == "spark.checkpoint.dir" else default)
    assert shared.shared_folder(spark) == str(tmp_path)
    kept = shared.keep(spark.range(3), "three")
    assert kept.count() == 3 and [p.name[:6] for p in tmp_path.iterdir()] == ["three-"]


def test_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        shared.shared_folder(Session())
