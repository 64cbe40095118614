"""Bars, statements and targets derived from the order lines: one stock per supplier, one bar per ship date.

The two SQL texts run unchanged on Spark and on DuckDB. Spark writes each derived table once per session.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlemill.operators.keyed import by_size, find_hot, tasks_for
from candlemill.operators.prices import adjusted_bars
from candlemill.operators.screen import breakout_screen
from candlemill.params import ScreenParams, TradeParams
from candlemill.plans.evaluate import limited_bars
from candlemill.plans.screen import run_stats
from candlemill.schemas import TARGET_HEADERS
from candlemill.sources.shared import dealt_into, keep, remove, shuffles_removed
from candlemill.sources.targets import read_targets
from fixtures.files import write_bar_files, write_statement_files

SCREEN = ScreenParams(earliest=datetime(1996, 1, 1))
TRADE = TradeParams()

CODE = """concat(case k%10 when 0 then 'sh600' when 1 then 'sz000' when 2 then 'sz300' when 3 then 'sh688'
                when 4 then 'bj430' when 5 then 'sz002' when 6 then 'sh603' when 7 then 'sz301'
                when 8 then 'sh601' else 'sh900' end, lpad(cast(k as varchar(20)), 5, '0'))"""

BARS_SQL = f"""
with g as (
  select l_suppkey k, cast(l_shipdate as date) d,
         sum(cast(round(l_discount*100) as int) - 5) * 60 bp,
         cast(sum(l_quantity) as bigint) vol, sum(l_linenumber) ln, max(l_linenumber) mx,
         sum(cast(round(l_extendedprice*100) as bigint)) cents
  from lineitem group by l_suppkey, cast(l_shipdate as date)),
w as (
  select *, cast(sum(bp) over (partition by k order by d) as bigint) cum,
         row_number() over (partition by k order by d) n from g),
p as (
  select *, 97.3137e0*exp(cum/10000.0e0)*(1+n*1.0e-5) c, 97.3137e0*exp((cum-bp)/10000.0e0)*(1+(n-1)*1.0e-5) pc,
         97.3137e0*exp((cum-bp)/10000.0e0)*(1+(n-1)*1.0e-5) * (1 + ((vol%7)-3)*0.002e0) o,
         case when n > 250 then 0.5e0 else 1.0e0 end sc from w),
b as (
  select {CODE} stock_code,
         s_name stock_name, d trade_date, sc*o open_price,
         sc*greatest(c,o)*(1+(ln%4)*0.004e0) high_price, sc*least(c,o)*(1-(mx%4)*0.004e0) low_price,
         sc*c close_price, case when n = 1 then cast(null as double) else sc*pc end prev_close_price,
         cast(vol as double) volume, cents/100.0e0 turnover,
         sc*c*1e6*(20+k%60) market_cap, sc*c*1.25e6*(20+k%60) total_market_cap,
         r_name industry_level1, n_name industry_level2,
         concat(n_name, '_', cast(k%3 as varchar(20))) industry_level3, k, n
  from p join supplier on s_suppkey = k join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey)
select stock_code, stock_name, trade_date, open_price, high_price, low_price, close_price, prev_close_price,
       volume, turnover, market_cap, total_market_cap, industry_level1, industry_level2, industry_level3 from b
union all
select stock_code, stock_name, trade_date, open_price, high_price, low_price, close_price, prev_close_price,
       volume, turnover, market_cap, total_market_cap, industry_level1, industry_level2, industry_level3 from b
where k%7 = 0 and n%50 = 0
"""

FINANCE_SQL = f"""
with f as (
  select l_suppkey k, year(l_shipdate) y, quarter(l_shipdate) q,
         sum(cast(round(l_extendedprice*100) as bigint)) rev,
         sum(cast(round(l_extendedprice*100) as bigint) * (6 - cast(round(l_discount*100) as int))) np,
         cast(sum(l_quantity) as bigint) qty
  from lineitem group by l_suppkey, year(l_shipdate), quarter(l_shipdate)),
b as (
  select {CODE} stock_code,
         concat(cast(y as varchar(4)), case q when 1 then '0331' when 2 then '0630' when 3 then '0930' else '1231' end) report_date,
         np/10000.0e0 R_np, rev/100.0e0 R_operating_total_revenue,
         rev/50.0e0 B_total_assets, qty*400.0e0 B_total_liab, rev/50.0e0 - qty*400.0e0 B_total_owner_equity, k, q from f)
select stock_code, report_date, R_np, R_operating_total_revenue, B_total_assets, B_total_liab, B_total_owner_equity
from b where not (k%5 = 1 and q = 3)
union all
select stock_code, report_date, R_np, R_operating_total_revenue, B_total_assets, B_total_liab, B_total_owner_equity
from b where k%7 = 0 and q = 2
"""

#: Bars whose vendor files lie on disk at a time, on average: about 270 bytes a bar.
FILE_ROWS = 10_000_000

SOURCE_TABLES = ("lineitem", "supplier", "nation", "region")


class Market:
    """The derived tables of one folder, each written on first use and shared by all queries of the session."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._tables: dict[str, object] = {}

    def _once(self, name: str, make):
        if name not in self._tables:
            self._tables[name] = make()
        return self._tables[name]

    def _derive(self, sql: str) -> DataFrame:
        for table in SOURCE_TABLES:
            path = f"{self.folder}/{table}.parquet"
            self.spark.read.parquet(path).createOrReplaceTempView(table)
        return self.spark.sql(sql)

    @property
    def bars(self) -> DataFrame:
        return self._once("bars", self._bars)

    def _bars(self) -> DataFrame:
        # A stock's dates are sorted in the task that has them: parts of so many order lines.
        lines = self.spark.read.parquet(f"{self.folder}/lineitem.parquet")
        with dealt_into(self.spark, tasks_for(lines)), shuffles_removed(self.spark):
            return keep(self._derive(BARS_SQL), "bars")

    @property
    def finance(self) -> DataFrame:
        return self._once("finance", lambda: keep(self._derive(FINANCE_SQL), "finance"))

    @property
    def bar_files(self) -> str:
        return self._once("bar_files", lambda: write_bar_files(self.bars))

    def in_parts(self, write: Callable[[DataFrame], str], read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
        """What `read` makes of the files that `write` makes of all bars, a part of the stocks at a time.

        `read` keeps what it has read, so the files of a part go before those of the next are written.
        """
        parts, found = max(1, ceil(self.bars.count() / FILE_ROWS)), []
        for part in range(parts):
            folder = write(self.bars.where(F.pmod(F.xxhash64("stock_code"), F.lit(parts)) == part))
            found.append(read(self.spark, folder))
            remove(self.spark, [folder])
        return reduce(DataFrame.unionByName, found)

    @property
    def statement_files(self) -> str:
        return self._once("statement_files", lambda: write_statement_files(self.finance))

    def adjusted(self) -> DataFrame:
        tasks = tasks_for(self.bars)
        return by_size(self.bars, find_hot(self.bars), lambda rows, split: adjusted_bars(rows, split, tasks=tasks))

    def stats(self, with_support_date: bool = False) -> DataFrame:
        return run_stats(self.bars, SCREEN, with_support_date)

    @property
    def limited(self) -> DataFrame:
        """Numbered bars of the support windows of all signals."""
        return self._once("limited", lambda: limited_bars(self.bars, self.targets, SCREEN, TRADE))

    def target_file(self) -> DataFrame:
        """All signals in the layout of a target file, codes in upper case."""
        date, code, name, price = TARGET_HEADERS
        return breakout_screen(self.stats(), SCREEN).select(
            F.date_format("trade_date", "yyyyMMdd").alias(date),
            F.upper("stock_code").alias(code),
            F.col("stock_name").alias(name),
            F.round("adj_close", 2).alias(price),
            F.datediff("trade_date", F.to_date(F.lit("1990-01-01"))).cast("long").alias("list_pos"),
        )

    @property
    def targets(self) -> DataFrame:
        """Targets; within a stock they are listed by date."""
        return self._once("targets", lambda: read_targets(keep(self.target_file(), "targets")))


_markets: dict[tuple[str, str], Market] = {}


def market(spark: SparkSession, folder: str) -> Market:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _markets:
        _markets[key] = Market(spark, folder)
    return _markets[key]
