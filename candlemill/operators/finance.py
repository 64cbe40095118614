"""Statements as of a trade date and their growth over the same quarter of the year before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlemill.functions import safe_div
from candlemill.operators.keyed import KEY, nearest, with_nearest
from candlemill.operators.windows import EXCLUDED_PREFIX
from candlemill.params import ScreenParams

REPORT_FORMAT = "yyyyMMdd"


def distinct_statements(finance: DataFrame, params: ScreenParams) -> DataFrame:
    """The queried statement columns without exact copies, from the earliest date on."""
    return _known_statements(finance, params).distinct()


def _known_statements(finance: DataFrame, params: ScreenParams) -> DataFrame:
    """The queried statement columns from the earliest date on.

    A report date that is no date raises, whatever the bound: only text of eight digits is compared as text first.
    """
    first = params.first_report_date
    return (
        finance.select(KEY, "report_date", "R_np", "R_operating_total_revenue")
        .filter(~F.col(KEY).startswith(EXCLUDED_PREFIX))
        .filter((F.col("report_date") >= first.strftime("%Y%m%d")) | ~F.col("report_date").rlike("^[0-9]{8}$"))
        .filter(F.to_date("report_date", REPORT_FORMAT) >= F.lit(first))
    )


def finance_asof(screened: DataFrame, statements: DataFrame) -> DataFrame:
    """Latest report date not after each distinct (stock, trade date), NULL where there is none.

    The report date decides, not the date of publication.
    """
    return _with_text(nearest(screened, _report_days(statements), ("trade_date", "report_day"), "report_day"))


def dated_statements(finance: DataFrame, params: ScreenParams) -> DataFrame:
    """A row per stock and report date, on one exchange by stock: `statement` holds the date and every distinct version
    next to each version of a year ago, with the growth in percent.

    Copies merge into versions before the exchange and after it. The statement of a year ago is the row whose date, as
    a number, is smaller by 10,000: a window frame of that one value, no join.
    """
    rows = _known_statements(finance, params).distinct().repartition(KEY)
    version = F.struct(F.col("R_np").alias("net_profit"), F.col("R_operating_total_revenue").alias("revenue"))
    dated = rows.groupBy(KEY, "report_date").agg(F.collect_set(version).alias("versions"))
    year_ago = Window.partitionBy(KEY).orderBy("_number").rangeBetween(-10_000, -10_000)
    before = F.first("versions").over(year_ago)
    dated = dated.withColumn("_number", F.col("report_date").cast("int")).withColumn("before", before)
    none = F.array(F.lit(None).cast("struct<net_profit:double,revenue:double>"))
    grown = F.flatten(F.transform("versions", lambda now: F.transform(F.coalesce("before", none), lambda then: F.struct(
        now["net_profit"].alias("latest_net_profit"), now["revenue"].alias("latest_revenue"),
        then["net_profit"].alias("last_year_net_profit"), then["revenue"].alias("last_year_revenue"),
        _growth(now["net_profit"], then["net_profit"]).alias("net_profit_yoy"),
        _growth(now["revenue"], then["revenue"]).alias("revenue_yoy"),
    ))))
    day = F.to_date("report_date", REPORT_FORMAT)
    return dated.select(KEY, day.alias("report_day"), F.struct(day.alias("report_day"), "report_date", grown.alias("versions")).alias("statement"))


def with_statement(screened: DataFrame, finance: DataFrame, params: ScreenParams, split: bool = False) -> DataFrame:
    """All screened rows with the growth of their latest statement, once per version of it; NULL where there is none."""
    found = with_nearest(screened, dated_statements(finance, params), ("trade_date", "report_day"), "statement", split)
    return _unfolded(found)


def finance_yoy(screened: DataFrame, finance: DataFrame, params: ScreenParams) -> DataFrame:
    """Latest and year-ago profit and revenue of each distinct (stock, trade date), with their growth."""
    found = _unfolded(nearest(screened, dated_statements(finance, params), ("trade_date", "report_day"), "statement"))
    return found.select(KEY, "trade_date", "latest_report_date", "latest_net_profit", "latest_revenue", "last_year_report_date", "last_year_net_profit", "last_year_revenue", "net_profit_yoy", "revenue_yoy")


def _unfolded(found: DataFrame) -> DataFrame:
    named = found.withColumn("latest_report_date", F.col("statement.report_date")).withColumn("last_year_report_date", _year_before(F.col("latest_report_date")))
    each = named.withColumn("_version", F.explode_outer("statement.versions"))
    return each.select("*", "_version.*").drop("statement", "_version")


def _report_days(statements: DataFrame) -> DataFrame:
    return statements.select(KEY, F.to_date("report_date", REPORT_FORMAT).alias("report_day"))


def _with_text(found: DataFrame) -> DataFrame:
    return found.withColumn("latest_report_date", F.date_format("report_day", REPORT_FORMAT)).drop("report_day")


def _year_before(report_date: Column) -> Column:
    year = F.substring(report_date, 1, 4).cast("int") - 1
    return F.concat(year.cast("string"), F.substring(report_date, 5, 4))


def _growth(latest: Column, base: Column) -> Column:
    """Percent change, NULL for a base of NULL or zero. A negative base turns the sign."""
    return F.round(safe_div(latest - base, base) * 100, 2)
