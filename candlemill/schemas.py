"""Table schemas and CSV headers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

# CSV header of a daily-bar file -> column of the bar table.
BAR_HEADERS = {
    "股票代码": "stock_code",
    "股票名称": "stock_name",
    "交易日期": "trade_date",
    "开盘价": "open_price",
    "最高价": "high_price",
    "最低价": "low_price",
    "收盘价": "close_price",
    "前收盘价": "prev_close_price",
    "成交量": "volume",
    "成交额": "turnover",
    "流通市值": "market_cap",
    "总市值": "total_market_cap",
    "净利润TTM": "net_profit_ttm",
    "现金流TTM": "cash_flow_ttm",
    "净资产": "net_assets",
    "总资产": "total_assets",
    "总负债": "total_liabilities",
    "净利润(当季)": "net_profit_quarter",
    "中户资金买入额": "mid_investor_buy",
    "中户资金卖出额": "mid_investor_sell",
    "大户资金买入额": "large_investor_buy",
    "大户资金卖出额": "large_investor_sell",
    "散户资金买入额": "retail_investor_buy",
    "散户资金卖出额": "retail_investor_sell",
    "机构资金买入额": "institutional_buy",
    "机构资金卖出额": "institutional_sell",
    "沪深300成分股": "hs300_component",
    "上证50成分股": "sse50_component",
    "中证500成分股": "csi500_component",
    "中证1000成分股": "csi1000_component",
    "中证2000成分股": "csi2000_component",
    "创业板指成分股": "gem_component",
    "新版申万一级行业名称": "industry_level1",
    "新版申万二级行业名称": "industry_level2",
    "新版申万三级行业名称": "industry_level3",
    "09:35收盘价": "price_0935",
    "09:45收盘价": "price_0945",
    "09:55收盘价": "price_0955",
}
BAR_TEXT = ("stock_code", "stock_name", "industry_level1", "industry_level2", "industry_level3")


def _bar_type(name: str) -> T.DataType:
    if name in BAR_TEXT:
        return T.StringType()
    if name == "trade_date":
        return T.DateType()
    return T.IntegerType() if name.endswith("_component") else T.DoubleType()


BAR_SCHEMA = T.StructType([T.StructField(name, _bar_type(name)) for name in BAR_HEADERS.values()])

# Text columns of a statement file and the suffix its headers carry.
FINANCE_TEXT = ("stock_code", "statement_format", "report_date", "publish_date", "抓取时间")
FINANCE_HEADER_SUFFIX = "@xbx"


def finance_schema(columns: Sequence[str]) -> T.StructType:
    """Schema of the statement table: the five text columns as text, every other column as double."""
    return T.StructType([
        T.StructField(name, T.StringType() if name in FINANCE_TEXT else T.DoubleType()) for name in columns
    ])


# Header of a target file -> column of the target table (the name header starts with four spaces).
TARGET_HEADERS = {
    "备注": "breakthrough_date",
    "代码": "stock_code",
    "    名称": "stock_name",
    "现价": "adj_stock_price",
}
