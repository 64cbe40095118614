"""Bars inside the support windows of a stock's signals, and pullbacks to the support price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlemill.functions import day_number
from candlemill.operators.keyed import KEY, SEGMENT_ROWS, windowed
from candlemill.operators.screen import breakout_screen, is_breakout
from candlemill.params import ScreenParams, TradeParams
from candlemill.sources.shared import keep

# Dip candidates are matched by price level first: prices within about two percent share a level.
LEVEL_WIDTH = 0.02
LEAST_PRICE = 1e-6


def support_window_bars(
    stats: DataFrame, params: ScreenParams, trade: TradeParams, split: bool = False
) -> DataFrame:
    """Bars within `days_limit` calendar days from the support date of any signal of their stock, prices rounded.

    `stats` must carry `max_close_date`. `rn` stays in the result: it orders a stock's bars.
    """
    if split:
        covered = _covered_by_stretch(keep(stats, "hot_stats"), params, trade)
    else:
        covered = _covered_by_scan(stats, params, trade)
    return covered.select(
        KEY, "stock_name", "trade_date", "rn",
        F.col("max_close_date").alias("adj_support_date"),
        F.round("max_close", 2).alias("adj_support_price"),
        *(F.round(f"adj_{p}", 2).alias(f"adj_{p}") for p in ("close", "high", "low", "open")),
        "industry_level2", "industry_level3",
    )


def _covered_by_scan(stats: DataFrame, params: ScreenParams, trade: TradeParams) -> DataFrame:
    """On the exchange the statistics already have: no join and no second reading.

    A signal gives a second row, dated at the support date it names, where a window starts. Going through a stock's rows
    by date, a bar is covered when the last start up to its date is near enough.
    """
    both, own = F.array(F.lit(False), F.lit(True)), F.array(F.lit(False))
    rows = stats.withColumn("_starts", F.explode(F.when(is_breakout(params), both).otherwise(own)))
    rows = rows.withColumn("_day", F.when(F.col("_starts"), F.col("max_close_date")).otherwise(F.col("trade_date")))
    to_date = Window.partitionBy(KEY).orderBy("_day")
    start = F.max(F.when(F.col("_starts"), F.col("_day"))).over(to_date)
    covered = rows.withColumn("_start", start).filter(~F.col("_starts"))
    return covered.filter(F.datediff("trade_date", "_start") <= trade.days_limit)


def _covered_by_stretch(stats: DataFrame, params: ScreenParams, trade: TradeParams) -> DataFrame:
    """By a join that also splits the bars of one stock.

    Cut the calendar into stretches as long as a window. A window that covers a bar then starts either in the bar's own
    stretch, not after the bar, or in the stretch before, late enough to reach it. The first start of the one and the
    last start of the other decide, so one row per stock and stretch replaces a join over date ranges.
    """
    length = trade.days_limit + 1
    starts = breakout_screen(stats, params).select(KEY, F.col("max_close_date").alias("start"))
    own = starts.select(KEY, _stretch(F.col("start"), length), F.col("start").alias("own"))
    after = starts.select(KEY, (_stretch(F.col("start"), length) + 1).alias("stretch"), F.col("start").alias("before"))
    reach = own.unionByName(after, allowMissingColumns=True).groupBy(KEY, "stretch").agg(
        F.min("own").alias("first_own"), F.max("before").alias("last_before")
    )
    day = F.col("trade_date")
    within = (day >= F.col("first_own")) | (day <= F.date_add("last_before", trade.days_limit))
    return stats.withColumn("stretch", _stretch(day, length)).join(reach, [KEY, "stretch"]).filter(within)


def number_bars(limited: DataFrame, split: bool = False, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Add `pos`, the position of each bar among its stock's limited bars, from 1."""
    return windowed(limited, ["rn"], 0, lambda rows, *_: rows, "pos", split, segment_rows)


def find_dips(numbered: DataFrame, targets: DataFrame, trade: TradeParams) -> DataFrame:
    """Every bar, from the second after a target's breakthrough on, that dips to the support price and closes above it.

    The support price is the one of the breakthrough bar. A target without a dip gives no row.
    """
    first_of_day = numbered.groupBy(KEY, "trade_date").agg(
        F.min(F.struct("pos", "adj_support_price", "adj_support_date")).alias("bar")
    )
    supported = (
        targets.select(KEY, "stock_name", "breakthrough_date")
        .join(first_of_day.withColumnRenamed("trade_date", "breakthrough_date"), [KEY, "breakthrough_date"])
        .select(
            KEY, "stock_name", "breakthrough_date",
            F.col("bar.adj_support_price").alias("support_price"),
            F.col("bar.adj_support_date").alias("support_date"),
            (F.col("bar.pos") + 2).alias("first_pos"),
        )
        .filter(F.col("support_price") != 0)
        .withColumn("level", _level(F.col("support_price")))
    )
    lower = F.col("adj_low") * trade.support_tolerance
    upper = F.least("adj_high", "adj_close")
    reached = (
        numbered.filter(lower <= upper)
        .select(
            KEY, "pos", F.col("trade_date").alias("dip_date"), "adj_high", "adj_close", lower.alias("lower"),
            F.explode(F.sequence(_level(lower), _level(upper))).alias("level"),
        )
    )
    support = F.col("support_price")
    return (
        supported.join(reached, [KEY, "level"])
        .filter(F.col("pos") >= F.col("first_pos"))
        .filter((F.col("adj_high") >= support) & (F.col("lower") <= support) & (F.col("adj_close") > support))
        .select(KEY, "stock_name", "breakthrough_date", "dip_date", "support_date", "support_price")
    )


def _stretch(day: Column, length: int) -> Column:
    return F.floor(day_number(day) / length).alias("stretch")


def _level(price: Column) -> Column:
    return F.floor(F.ln(F.greatest(price, F.lit(LEAST_PRICE))) / LEVEL_WIDTH)
