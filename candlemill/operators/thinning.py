"""Rules that thin out a stock's signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from candlemill.functions import business_day_gap
from candlemill.operators.keyed import KEY, SEGMENT_ROWS, row_hash, windowed
from candlemill.params import ScreenParams


def drop_consecutive_higher(
    signals: DataFrame, split: bool = False, segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Drop a signal one business day after the stock's previous signal when it closes higher.

    The previous signal counts even if it is dropped itself.
    """

    def build(rows: DataFrame, window: WindowSpec, _: WindowSpec) -> DataFrame:
        gap = business_day_gap(F.lag("trade_date").over(window), F.col("trade_date"))
        higher = F.col("adj_close") > F.lag("adj_close").over(window)
        return rows.withColumn("_dropped", F.coalesce((gap == 1) & higher, F.lit(False)))

    ordered = signals.withColumn("_version", row_hash(signals, KEY, "trade_date"))
    marked = windowed(ordered, ["trade_date", "_version"], 1, build, "_number", split, segment_rows)
    return marked.filter(~F.col("_dropped")).select(*signals.columns)


def thin_signals(signals: DataFrame, range_days: int) -> DataFrame:
    """Keep a stock's signals that stand alone for more than `range_days` business days, and always the first.

    Going by date, a signal within range of the anchor removes itself and the anchor, which stays in place; a later one
    becomes the anchor. Signals are folded to one row per stock and date first, so the list of a stock is no longer
    than the calendar: of several signals on a date the second is within range of the first.
    """
    rest = [c for c in signals.columns if c not in (KEY, "trade_date")]
    days = signals.groupBy(KEY, "trade_date").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*rest)).alias("first")
    )
    lists = days.groupBy(KEY).agg(
        F.array_sort(F.collect_list(F.struct("trade_date", "n", "first"))).alias("days")
    )
    chained = lists.withColumn("anchors", _anchors(F.transform("days", lambda d: d["trade_date"]), range_days))

    def stays(day: Column, i: Column) -> Column:
        following = F.get(F.col("days"), i + 1)["trade_date"]
        alone = (day["n"] == 1) & (following.isNull() | F.array_contains(F.col("anchors"), following))
        return (i == 0) | (F.array_contains(F.col("anchors"), day["trade_date"]) & alone)

    kept = chained.select(KEY, F.explode(F.filter("days", stays)).alias("day"))
    return kept.select(KEY, "day.trade_date", "day.first.*").select(*signals.columns)


def apply_thinning(signals: DataFrame, params: ScreenParams, split: bool = False) -> DataFrame:
    """Thin by the rule the parameters name."""
    if params.thinning == "1.2":
        return thin_signals(signals, params.range_days)
    return drop_consecutive_higher(signals, split)


def _anchors(dates: Column, range_days: int) -> Column:
    """Greedy chain of dates, each more than `range_days` business days after the one before it in the chain."""

    def step(chain: Column, day: Column) -> Column:
        last = F.get(chain, F.size(chain) - 1)
        far = F.coalesce(business_day_gap(last, day) > range_days, F.lit(True))
        return F.when(far, F.concat(chain, F.array(day))).otherwise(chain)

    return F.aggregate(dates, F.array().cast("array<date>"), step)
