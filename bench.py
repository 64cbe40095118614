"""Headline timings on the derived tables; prints one JSON line.

The bars and statements are derived and written once beforehand, like the tables a user already has. Each query then
runs twice to warm up and three times on the clock, all its rows going to the noop sink; the middle time counts.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from candlemill.operators.lookups import bars_between
from candlemill.operators.prices import adjusted_bars
from candlemill.operators.screen import breakout_screen, signals
from candlemill.operators.support import support_window_bars
from candlemill.operators.windows import rolling_stats
from candlemill.plans.evaluate import run_dips, run_trades
from candlemill.plans.screen import run_screen
from candlemill.sources.csv_files import accepted, read_bar_files
from fixtures.market import SCREEN, TRADE, market
from fixtures.registry import FIRST_DAY, LAST_DAY

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WARM_UPS, RUNS = 2, 3


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS if CPUS.isdigit() else "8")
        .config("spark.driver.memory", "8g")
        # A job compiles more classes than the default cache of 100 holds, so that repeated runs would start cold.
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='bench-')}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(make) -> float:
    times = []
    for _ in range(WARM_UPS + RUNS):
        start = time.perf_counter()
        df: DataFrame = make()
        df.write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times[WARM_UPS:]), 3)


def main() -> None:
    spark = session()
    m = market(spark, FOLDER)
    start = time.perf_counter()
    bars, finance, files = m.bars, m.finance, m.bar_files
    targets = m.targets
    prepared = round(time.perf_counter() - start, 3)

    def stats(with_date: bool = False) -> DataFrame:
        return rolling_stats(adjusted_bars(bars), SCREEN, with_support_date=with_date)

    timed = {
        "adjusted_bars": lambda: adjusted_bars(bars),
        "rolling_stats": stats,
        "rolling_stats_with_date": lambda: stats(True),
        "breakout_screen": lambda: breakout_screen(stats(), SCREEN),
        "signals_with_growth": lambda: signals(breakout_screen(stats(), SCREEN), finance, SCREEN),
        "screen_job": lambda: run_screen(bars, finance, SCREEN),
        "support_windows": lambda: support_window_bars(stats(True), SCREEN, TRADE),
        "dip_job": lambda: run_dips(bars, targets, SCREEN, TRADE),
        "trade_job": lambda: run_trades(bars, targets, SCREEN, TRADE),
        "bar_ingest": lambda: accepted(read_bar_files(spark, files)),
        "bars_between": lambda: bars_between(bars, FIRST_DAY, LAST_DAY),
    }
    found = {name: seconds(make) for name, make in timed.items()}
    print(json.dumps({
        "metric": "total of median query seconds", "value": round(sum(found.values()), 3), "unit": "sec",
        "queries": found, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"), "cpus": CPUS,
        "prepare_sec": prepared, "bars": bars.count(),
    }))


if __name__ == "__main__":
    main()
