"""Registered queries: each is one operator on the derived tables, next to the SQL that checks it.

Prices differ between engines in the last digits, so both sides round what they return.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlemill.functions import amplitude, amplitude_limit, business_day_gap
from candlemill.operators import finance as fin
from candlemill.operators import lookups
from candlemill.operators.keyed import number_rows
from candlemill.operators.prices import distinct_bars, drilldown
from candlemill.operators.report import REPORT_NAMES, pnl_report, position_ledger
from candlemill.operators.screen import SIGNAL_COLUMNS, amplitude_ok, breakout_screen
from candlemill.operators.support import find_dips
from candlemill.operators.thinning import thin_signals
from candlemill.operators.trades import apply_exit_rules, size_entries
from candlemill.params import ScreenParams
from candlemill.plans.evaluate import run_dips, run_support_windows, run_trades
from candlemill.plans.screen import run_screen, run_signals
from candlemill.sources.csv_files import PATH, REASON, accepted, read_bar_files, read_finance_files, rejected
from candlemill.schemas import BAR_SCHEMA
from candlemill.sources.shared import new_folder
from candlemill.sources.sinks import display_report, display_signals, write_dips, write_report, write_signals
from candlemill.sources.tables import append_statements, read_table, write_bars
from candlemill.sources.targets import read_targets
from fixtures.files import CHINESE, DAMAGES, IN_GB2312, IN_LINES, STOCK_NUMBER, write_bar_files, write_damaged_bar_files
from fixtures.market import SCREEN, TRADE, Market, market
from fixtures.oracle import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WITH_GAIN = replace(SCREEN, require_gain=True)
WITH_GROWTH = replace(SCREEN, require_growth=True)
DRILL_CODE, DRILL_DAY = "SZ00000001", date(1998, 6, 1)
FIRST_DAY, LAST_DAY = date(1997, 6, 1), date(1997, 6, 30)


def register(name: str, oracle: str) -> Callable[[Callable[[Market], DataFrame]], None]:
    def add(build: Callable[[Market], DataFrame]) -> None:
        QUERIES[name] = lambda spark, folder: build(market(spark, folder))
        ORACLES[name] = oracle

    return add


def rounded(*names: str, digits: int = 2) -> list:
    return [F.round(n, digits).alias(n) for n in names]


def rounds(*names: str, digits: int = 2) -> str:
    return ", ".join(f"round({n}, {digits}) {n}" for n in names)


RAW = ("open_price", "close_price", "high_price", "low_price", "prev_close_price")
ADJ = ("adj_close", "adj_open", "adj_high", "adj_low", "adj_prev_close")
EXTREMES = ("max_close", "max_high", "min_low", "first_open")
CAPS = ("float_cap", "total_cap")
INDUSTRY = "industry_level1, industry_level2, industry_level3"
SCREENED = f"stock_code, stock_name, trade_date, {rounds('adj_close', 'max_close', *CAPS)}, {INDUSTRY}"


def _screened(df: DataFrame) -> DataFrame:
    return df.select(
        "stock_code", "stock_name", "trade_date", *rounded("adj_close", "max_close", *CAPS), *INDUSTRY.split(", ")
    )


@register("distinct_bars", sql(
    f"select stock_code, stock_name, trade_date, {rounds(*RAW)}, {rounds('market_cap', 'total_market_cap', digits=0)}, "
    f"{INDUSTRY} from d", "d"))
def _(m: Market) -> DataFrame:
    return distinct_bars(m.bars).select(
        "stock_code", "stock_name", "trade_date", *rounded(*RAW),
        *rounded("market_cap", "total_market_cap", digits=0), *INDUSTRY.split(", "),
    )


FLAGS = ("hs300_component", "gem_component")


@register("bar_csv_ingest", sql(
    f"""select stock_code, case when {STOCK_NUMBER} % 9 = {IN_GB2312} then '{CHINESE}' || stock_name else stock_name end stock_name,
               trade_date, {rounds(*RAW, 'turnover')}, volume, industry_level1,
               case when {STOCK_NUMBER} % 9 = {IN_LINES} then replace(industry_level2, ' ', chr(10)) else industry_level2 end industry_level2,
               industry_level3, {', '.join(f'cast(cast(volume as bigint) % 2 = 0 as integer) {c}' for c in FLAGS)},
               cast(null as double) net_assets from bars""", "bars"))
def _(m: Market) -> DataFrame:
    return _ingested(m.in_parts(write_bar_files, read_bar_files))


@register("bar_csv_rejects", sql(
    f"""select distinct stock_code, case {STOCK_NUMBER} % 6 {' '.join(f"when {k} then '{why}'" for k, why in DAMAGES.items())} end reason
        from bars where {STOCK_NUMBER} % 6 in ({', '.join(map(str, DAMAGES))})
        union all select 'rows of other files', cast(count(*) as varchar) from bars where {STOCK_NUMBER} % 6 not in ({', '.join(map(str, DAMAGES))})""", "bars"))
def _(m: Market) -> DataFrame:
    parsed = m.in_parts(write_damaged_bar_files, read_bar_files)
    kind = F.coalesce(*(F.when(F.contains(REASON, F.lit(why)), why) for why in DAMAGES.values()), F.col(REASON))
    name = F.regexp_extract(PATH, r"([^/]+)\.csv$", 1)
    kept = accepted(parsed).agg(F.lit("rows of other files").alias("stock_code"), F.count("*").cast("string").alias("reason"))
    return rejected(parsed).select(name.alias("stock_code"), kind.alias("reason")).unionByName(kept)


@register("finance_csv_ingest", sql(
    "select stock_code, report_date, R_np, R_operating_total_revenue, B_total_assets, B_total_liab, B_total_owner_equity, "
    "cast(null as varchar) 抓取时间 from fin", "fin"))
def _(m: Market) -> DataFrame:
    return accepted(read_finance_files(m.spark, m.statement_files))


def _ingested(parsed: DataFrame) -> DataFrame:
    return accepted(parsed).select(
        "stock_code", "stock_name", "trade_date", *rounded(*RAW, "turnover"), "volume", *INDUSTRY.split(", "),
        *FLAGS, "net_assets",
    )


@register("adjusted_bars", sql(
    f"select stock_code, trade_date, round(factor, 6) factor, {rounds(*ADJ)} from adj", "adj"))
def _(m: Market) -> DataFrame:
    return m.adjusted().select("stock_code", "trade_date", *rounded("factor", digits=6), *rounded(*ADJ))


@register("rolling_stats", sql(
    f"select stock_code, trade_date, rn, has_gain, {rounds(*EXTREMES, *CAPS)} from win", "win"))
def _(m: Market) -> DataFrame:
    return m.stats().select("stock_code", "trade_date", "rn", "has_gain", *rounded(*EXTREMES, *CAPS))


@register("support_date", sql(
    "select stock_code, trade_date, max_close_date, round(max_close, 2) max_close from win", "win"))
def _(m: Market) -> DataFrame:
    return m.stats(with_support_date=True).select(
        "stock_code", "trade_date", "max_close_date", *rounded("max_close"))


@register("gain_flag", sql("select stock_code, trade_date, has_gain from win", "win"))
def _(m: Market) -> DataFrame:
    return m.stats().select("stock_code", "trade_date", "has_gain")


@register("amplitude_ok", sql(
    "select stock_code, trade_date, round(amplitude, 4) amplitude, cast(amplitude_limit as double) amplitude_limit, "
    "amplitude <= amplitude_limit amplitude_ok from amp", "amp"))
def _(m: Market) -> DataFrame:
    limit = amplitude_limit(F.col("stock_code"), SCREEN.main_amplitude, SCREEN.growth_amplitude)
    return m.stats().select(
        "stock_code", "trade_date",
        F.round(amplitude(F.col("max_high"), F.col("min_low"), F.col("first_open")), 4).alias("amplitude"),
        limit.alias("amplitude_limit"), amplitude_ok(SCREEN).alias("amplitude_ok"),
    )


@register("breakout_screen", sql(f"select {SCREENED} from scr", "scr"))
def _(m: Market) -> DataFrame:
    return _screened(breakout_screen(m.stats(), SCREEN))


@register("screen_with_gain", sql(f"select {SCREENED} from scr where has_gain = 1", "scr"))
def _(m: Market) -> DataFrame:
    return _screened(breakout_screen(m.stats(), WITH_GAIN))


@register("distinct_statements", sql("select * from st", "st"))
def _(m: Market) -> DataFrame:
    return fin.distinct_statements(m.finance, SCREEN)


@register("finance_asof", sql("select stock_code, trade_date, latest_report_date from lat", "lat"))
def _(m: Market) -> DataFrame:
    return fin.finance_asof(breakout_screen(m.stats(), SCREEN), fin.distinct_statements(m.finance, SCREEN))


@register("finance_yoy", sql(
    "select stock_code, trade_date, latest_report_date, latest_net_profit, latest_revenue, last_year_report_date, "
    "last_year_net_profit, last_year_revenue, net_profit_yoy, revenue_yoy from yoy", "yoy"))
def _(m: Market) -> DataFrame:
    return fin.finance_yoy(breakout_screen(m.stats(), SCREEN), m.finance, SCREEN)


@register("signals", sql(f"select {', '.join(SIGNAL_COLUMNS)} from sig", "sig"))
def _(m: Market) -> DataFrame:
    return run_signals(m.bars, m.finance, SCREEN)


@register("signals_cond5", sql(
    f"select {', '.join(SIGNAL_COLUMNS)} from sig where net_profit_yoy >= -20 and revenue_yoy >= -20", "sig"))
def _(m: Market) -> DataFrame:
    return run_signals(m.bars, m.finance, WITH_GROWTH)


@register("signals_display", sql(
    "select stock_code 股票代码, stock_name 股票名称, trade_date 交易日期, adj_close 前复权_收盘价, "
    'support_price 前复权_前40天最高收盘价, float_cap "流市值(亿)", total_cap "总市值(亿)", latest_net_profit "季净利润(亿)", '
    'latest_revenue "季总营收(亿)", net_profit_yoy 净利润同比增长率, revenue_yoy 营收同比增长率, industry_level1 所属领域1, '
    "industry_level2 所属领域2, industry_level3 所属领域3 from sig", "sig"))
def _(m: Market) -> DataFrame:
    return display_signals(run_signals(m.bars, m.finance, SCREEN), SCREEN)


@register("business_day_gap", sql(
    """, p as (select stock_code, trade_date, lag(trade_date) over (partition by stock_code order by trade_date) before
               from (select distinct stock_code, trade_date from bars)),
       days as (select cast(r.x as date) as dy, count(*) filter (isodow(r.x) <= 5) over (order by r.x) weekdays
                from range(timestamp '1990-01-01', timestamp '2010-01-01', interval 1 day) r(x))
       select p.stock_code, p.trade_date, b.weekdays - a.weekdays - 1 gap
       from p left join days a on a.dy = p.before - 1 left join days b on b.dy = p.trade_date""", "bars"))
def _(m: Market) -> DataFrame:
    days = m.bars.select("stock_code", "trade_date").distinct()
    before = F.lag("trade_date").over(Window.partitionBy("stock_code").orderBy("trade_date"))
    return days.select("stock_code", "trade_date", business_day_gap(before, F.col("trade_date")).alias("gap"))


PREVIOUS = """, p as (
    select *, lag(trade_date) over w before, lag(adj_close) over w close_before from sig
    window w as (partition by stock_code order by trade_date)),
  g as (select *, (select count(*) from range(cast(before as timestamp), trade_date + interval 1 day, interval 1 day) r(x)
                   where isodow(r.x) <= 5) - 1 gap from p)"""


@register("drop_consecutive_higher", sql(
    f"{PREVIOUS} select {', '.join(SIGNAL_COLUMNS)} from g "
    "where not coalesce(gap = 1 and adj_close > close_before, false)", "sig"))
def _(m: Market) -> DataFrame:
    return run_screen(m.bars, m.finance, SCREEN)


CHAIN = """, n as (select *, row_number() over (partition by stock_code order by trade_date) i from sig),
  chain as (
    select stock_code, i, trade_date anchor, true is_anchor from n where i = 1
    union all
    select n.stock_code, n.i, case when f.far then n.trade_date else c.anchor end, f.far
    from chain c join n on n.stock_code = c.stock_code and n.i = c.i + 1,
    lateral (select (select count(*) from range(cast(c.anchor as timestamp), n.trade_date + interval 1 day,
                                                interval 1 day) r(x) where isodow(r.x) <= 5) - 1 > 5 far) f),
  k as (select *, coalesce(lead(is_anchor) over (partition by stock_code order by i), true) next_is from chain)"""


@register("thin_signals", sql(
    f"{CHAIN} select {', '.join('n.' + c for c in SIGNAL_COLUMNS)} from n join k on k.stock_code = n.stock_code "
    "and k.i = n.i where k.i = 1 or (k.is_anchor and k.next_is)", "sig"))
def _(m: Market) -> DataFrame:
    return thin_signals(run_signals(m.bars, m.finance, SCREEN), SCREEN.range_days)


LIMITED = ("stock_code", "stock_name", "trade_date", "adj_support_date", "adj_support_price", "adj_close", "adj_high",
           "adj_low", "adj_open", "industry_level2", "industry_level3")


@register("support_window_bars", sql(f"select {', '.join(LIMITED)} from lim", "lim"))
def _(m: Market) -> DataFrame:
    return run_support_windows(m.bars, SCREEN, TRADE).select(*LIMITED)


@register("target_list", sql(
    "select breakthrough_date, stock_code, stock_name, adj_stock_price, list_pos from tgt", "tgt"))
def _(m: Market) -> DataFrame:
    return read_targets(m.target_file())


@register("find_dips", sql(
    """select t.stock_code, t.stock_name, t.breakthrough_date, c.trade_date dip_date, b.adj_support_date support_date,
              b.adj_support_price support_price
       from tgt t join num b on b.stock_code = t.stock_code and b.trade_date = t.breakthrough_date
       join num c on c.stock_code = t.stock_code and c.pos >= b.pos + 2
       where b.adj_support_price <> 0 and c.adj_high >= b.adj_support_price
         and c.adj_low * 0.995e0 <= b.adj_support_price and c.adj_close > b.adj_support_price""", "tgt", "num"))
def _(m: Market) -> DataFrame:
    return find_dips(m.limited, m.targets, TRADE)


ENTRY = ("stock_code", "stock_name", "breakthrough_date", "list_pos", "entry_pos", "bought_date", "entry_open",
         "entry_close", "support", "shares_at_open", "shares_at_close", "total_shares")


@register("size_entries", sql(
    f"select {', '.join(ENTRY)}, cost, cost_price, cost_price * 0.95e0 stop_price from pos", "pos"))
def _(m: Market) -> DataFrame:
    return size_entries(m.limited, m.targets, TRADE).select(*ENTRY, "cost", "cost_price", "stop_price")


def _positions(m: Market) -> DataFrame:
    return apply_exit_rules(size_entries(m.limited, m.targets, TRADE), m.limited, TRADE)


SALES = ("half_shares", "half_price", "half_bar_close", "exit_shares", "exit_price", "exit_bar_close")


@register("apply_exit_rules", sql(
    f"select stock_code, list_pos, bought_date, cast(half_day as integer) half_day, half_date, "
    f"cast(exit_day as integer) exit_day, exit_date, {', '.join(SALES)} from ex", "ex"))
def _(m: Market) -> DataFrame:
    return _positions(m).select(
        "stock_code", "list_pos", "bought_date", "half_day", "half_date", "exit_day", "exit_date", *SALES)


LEDGER = ("stock_code", "stock_name", "support_date", "bought_date", "trade_date")
LEDGER_VALUES = ("init_cash", "support_price", "total_shares", "current_cash", "current_positions", "market_value")
# A price per share is a quotient, which may end in a half at few digits.
COST_SQL = "round(cost_price, 9) cost_price"


@register("position_ledger", sql(
    f"select {', '.join(LEDGER)}, cast(holding_days as integer) holding_days, cast(max_holding_days as integer) "
    f"max_holding_days, {', '.join(f'round(cast({c} as double), 4) {c}' for c in LEDGER_VALUES)}, {COST_SQL} from led", "led"))
def _(m: Market) -> DataFrame:
    return position_ledger(_positions(m), TRADE).select(
        *LEDGER, "holding_days", "max_holding_days", *rounded(*LEDGER_VALUES, digits=4), *rounded("cost_price", digits=9))


MONEY = ("init_cash", "total_shares", "market_value", "profit")
REPORT_SQL = f"""
    select cast(row_number() over (order by stock_code, stock_name) as bigint) no, stock_code, stock_name, bought_date,
           trade_date, cast(holding_days as integer) holding_days, cast(max_holding_days as integer) max_holding_days,
           {', '.join(f'round(cast({c} as double), 4) {c}' for c in MONEY)}, {COST_SQL},
           round(profit_percent, 8) profit_percent, profit > 0 is_profit from rep
    union all
    select null, null, '总投资金额', null, null, null, null, sum(init_cash), null, round(sum(market_value), 4),
           round(sum(market_value) - sum(init_cash), 4), null,
           round((sum(market_value) - sum(init_cash)) / sum(init_cash), 8), null from rep"""


def _report(m: Market) -> DataFrame:
    return _shown(pnl_report(position_ledger(_positions(m), TRADE)))


def _shown(report: DataFrame) -> DataFrame:
    money = {c: F.round(c, 4) for c in MONEY}
    return report.withColumns({**money, "cost_price": F.round("cost_price", 9),
                               "profit_percent": F.round("profit_percent", 8)})


@register("pnl_report", sql(REPORT_SQL, "rep"))
def _(m: Market) -> DataFrame:
    return _report(m)


@register("pnl_display", sql(
    f""", r as ({REPORT_SQL})
    select {', '.join(f'{c} "{n}"' for c, n in REPORT_NAMES.items() if c != 'max_holding_days')},
           case when no is null then '总市值' else cast(max_holding_days as varchar) end "最大持有天数" from r""", "rep"))
def _(m: Market) -> DataFrame:
    return display_report(_report(m))


@register("drilldown", sql(
    f"""select stock_code, trade_date, stock_name, volume, round(adj_close, 2) as close, round(adj_high, 2) high,
               round(adj_low, 2) low, round(adj_open, 2) as open, industry_level2, industry_level3
        from adj join (select distinct stock_code, trade_date, volume from bars) v using (stock_code, trade_date)
        where stock_code = lower('{DRILL_CODE}') and trade_date = date '{DRILL_DAY}'""", "adj"))
def _(m: Market) -> DataFrame:
    shown = drilldown(m.bars, DRILL_CODE, SCREEN.first_trade_date, DRILL_DAY)
    return shown.withColumns({c: F.round(c, 2) for c in ("close", "high", "low", "open")})


@register("bars_between", sql(
    f"select trade_date, round(close_price, 2) close_price, volume from bars "
    f"where trade_date between date '{FIRST_DAY}' and date '{LAST_DAY}'", "bars"))
def _(m: Market) -> DataFrame:
    return lookups.bars_between(m.bars, FIRST_DAY, LAST_DAY).withColumn("close_price", F.round("close_price", 2))


@register("bars_preview", sql(
    f"select trade_date, round(close_price, 2) close_price, volume from bars where trade_date between "
    f"date '{FIRST_DAY}' and date '{LAST_DAY}' order by trade_date, stock_code, bars.close_price, volume limit 5", "bars"))
def _(m: Market) -> DataFrame:
    found = lookups.preview(lookups.bars_between(m.bars, FIRST_DAY, LAST_DAY))
    return found.withColumn("close_price", F.round("close_price", 2))


@register("statements_between", sql(
    "select stock_code, report_date, B_total_assets, B_total_liab, B_total_owner_equity from fin "
    "where report_date between '19970601' and '19971231'", "fin"))
def _(m: Market) -> DataFrame:
    return lookups.statements_between(m.finance, "19970601", "19971231")


@register("row_count", sql("select count(*) n_rows from bars", "bars"))
def _(m: Market) -> DataFrame:
    return lookups.row_count(m.bars)


# The complete jobs, from the two tables and the target list.


@register("screen_job_with_growth", sql(
    f"{PREVIOUS.replace('from sig', 'from (select * from sig where net_profit_yoy >= -20 and revenue_yoy >= -20)')} "
    f"select {', '.join(SIGNAL_COLUMNS)} from g where not coalesce(gap = 1 and adj_close > close_before, false)", "sig"))
def _(m: Market) -> DataFrame:
    return run_screen(m.bars, m.finance, WITH_GROWTH)


@register("screen_job_rule_1_2", ORACLES["thin_signals"])
def _(m: Market) -> DataFrame:
    return run_screen(m.bars, m.finance, replace(SCREEN, thinning="1.2"))


@register("dip_job", ORACLES["find_dips"])
def _(m: Market) -> DataFrame:
    return run_dips(m.bars, m.targets, SCREEN, TRADE)


@register("trade_job", ORACLES["pnl_report"])
def _(m: Market) -> DataFrame:
    return _shown(run_trades(m.bars, m.targets, SCREEN, TRADE))


def _in_file_order(df: DataFrame) -> DataFrame:
    """Rows with their place in a written result, file after file; ranges of rows are numbered side by side."""
    rows = df.withColumns({"_file": F.col("_metadata.file_name"), "_at": F.monotonically_increasing_id()})
    return number_rows(rows, ["_file", "_at"], "place").drop("_file", "_at")


@register("bar_table_round_trip", sql(
    f"select stock_code, stock_name, trade_date, {rounds(*RAW, 'turnover')}, volume, {INDUSTRY}, "
    "cast(null as double) net_assets, cast(null as integer) gem_component from bars", "bars"))
def _(m: Market) -> DataFrame:
    path = new_folder(m.spark, "bar-table")
    write_bars(m.bars, path)
    return read_table(m.spark, path, BAR_SCHEMA).select(
        "stock_code", "stock_name", "trade_date", *rounded(*RAW, "turnover"), "volume", *INDUSTRY.split(", "),
        "net_assets", "gem_component",
    )


@register("statement_append", sql(
    "select stock_code, report_date, cast(round(R_np * 10000) as bigint) np_units, count(*) n, cast(null as double) R_extra from "
    "(select * from fin union all select * from fin) group by 1, 2, 3", "fin"))
def _(m: Market) -> DataFrame:
    path = new_folder(m.spark, "statements")
    append_statements(m.finance.withColumn("R_extra", F.lit(None).cast("double")), path)
    append_statements(m.finance.withColumn("R_new", F.lit(1.0)), path)
    back = read_table(m.spark, path)
    # Profits are whole ten-thousandths, of which a rounded hundredth may go either way.
    by = back.groupBy("stock_code", "report_date", F.round(F.col("R_np") * 10000).cast("long").alias("np_units"))
    return by.agg(F.count("*").alias("n"), F.max("R_extra").alias("R_extra"))


@register("signals_export", sql(
    "select row_number() over (order by stock_code, trade_date) place, stock_code, cast(trade_date as varchar) trade_date, "
    "adj_close, support_price from sig", "sig"))
def _(m: Market) -> DataFrame:
    path = new_folder(m.spark, "signals")
    write_signals(QUERIES["signals"](m.spark, m.folder), SCREEN, path)
    back = _in_file_order(m.spark.read.option("header", True).csv(path))
    return back.select(
        "place", F.col("股票代码").alias("stock_code"), F.col("交易日期").alias("trade_date"),
        F.col("前复权_收盘价").cast("double").alias("adj_close"), F.col("前复权_前40天最高收盘价").cast("double").alias("support_price"),
    )


@register("report_export", sql(
    "select row_number() over (order by no nulls last) place, no, stock_code, round(profit, 2) profit "
    f"from ({REPORT_SQL})", "rep"))
def _(m: Market) -> DataFrame:
    path = new_folder(m.spark, "report")
    write_report(QUERIES["pnl_report"](m.spark, m.folder), path)
    back = _in_file_order(m.spark.read.option("header", True).csv(path))
    return back.select(
        "place", F.col(REPORT_NAMES["no"]).cast("long").alias("no"), F.col(REPORT_NAMES["stock_code"]).alias("stock_code"),
        F.round(F.col(REPORT_NAMES["profit"]).cast("double"), 2).alias("profit"),
    )


DIP_TEXT = ("breakthrough_date", "dip_date", "support_date")


@register("dips_export", f"select stock_code, stock_name, {', '.join(f'cast({c} as varchar) {c}' for c in DIP_TEXT)}, support_price "
          f"from ({ORACLES['find_dips']})")
def _(m: Market) -> DataFrame:
    path = new_folder(m.spark, "dips")
    write_dips(QUERIES["find_dips"](m.spark, m.folder), path)
    return m.spark.read.option("header", True).csv(path).withColumn("support_price", F.col("support_price").cast("double"))


SETTINGS = {
    "earliest_time_limit": "1996-01-01 00:00:00", "cond1_and_cond3": "40_25_35", "cond2": "0.05", "apply_cond2_or_not": "yes",
    "max_market_capitalization": "400", "min_market_capitalization": "40", "apply_cond5_or_not": "no", "use_cond_1_1_or_cond_1_2": "1.1",
}
BY_SETTINGS = """from (select sig.* from sig semi join (select * from scr where has_gain = 1 and float_cap between 40 and 400)
                 using (stock_code, trade_date))"""


@register("screen_from_settings", sql(
    f"{PREVIOUS.replace('from sig', BY_SETTINGS)} select {', '.join(SIGNAL_COLUMNS)} from g "
    "where not coalesce(gap = 1 and adj_close > close_before, false)", "sig"))
def _(m: Market) -> DataFrame:
    return run_screen(m.bars, m.finance, ScreenParams.from_settings(SETTINGS))
