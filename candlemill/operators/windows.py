"""Rolling statistics of a stock's previous bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from candlemill.functions import safe_div
from candlemill.operators.keyed import KEY, SEGMENT_ROWS, highest_before, windowed
from candlemill.operators.prices import BAR_ORDER
from candlemill.params import ScreenParams

EXCLUDED_PREFIX = "bj"
CAP_UNIT = 100_000_000
FAR_DAY = "2100-01-01"


def rolling_stats(
    adjusted: DataFrame,
    params: ScreenParams,
    split: bool = False,
    with_support_date: bool = False,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Statistics of the `history_bars` bars before each bar, the bar itself left out.

    Adds `max_close`, `max_high`, `min_low`, `first_open`, `has_gain`, the bar number `rn`, both caps in 1e8 and, when
    asked for, `max_close_date`: the earliest date of the highest close.
    """
    n = params.history_bars
    listed = adjusted.filter(
        ~F.col(KEY).startswith(EXCLUDED_PREFIX) & (F.col("trade_date") >= F.lit(params.first_trade_date))
    )
    gain = safe_div(F.col("adj_close") - F.col("adj_prev_close"), F.col("adj_prev_close"))
    far_day = F.to_date(F.lit(FAR_DAY))

    def build(rows: DataFrame, window: WindowSpec, backwards: WindowSpec) -> DataFrame:
        highest = lambda value: highest_before(value, "rn", n, window, backwards)
        earliest = F.first("adj_open").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        first = F.when(F.col("rn") > n, F.lag("adj_open", n).over(window)).otherwise(earliest)
        stats = {
            "max_close": highest(F.col("adj_close")),
            "max_high": highest(F.col("adj_high")),
            "min_low": -highest(-F.col("adj_low")),
            "first_open": F.when(F.col("rn") > 1, first),
            "has_gain": highest(F.when(gain >= params.gain, 1).otherwise(0)),
        }
        if with_support_date:
            # Of equal closes the earlier one is the larger struct.
            dated = F.struct("adj_close", F.datediff(far_day, F.col("trade_date")).alias("to_far"))
            stats["_highest"] = highest(F.when(F.col("adj_close").isNotNull(), dated))
        return rows.withColumns(stats)

    stats = windowed(listed, BAR_ORDER, n, build, "rn", split, segment_rows).withColumns({
        "float_cap": F.col("market_cap") / CAP_UNIT,
        "total_cap": F.col("total_market_cap") / CAP_UNIT,
    })
    if with_support_date:
        stats = stats.withColumn("max_close_date", F.date_sub(far_day, F.col("_highest.to_far"))).drop("_highest")
    return stats
