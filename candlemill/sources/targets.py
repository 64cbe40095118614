"""Target lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.schemas import TARGET_HEADERS


def read_targets(listed: DataFrame) -> DataFrame:
    """Typed targets from a table with the headers of a target file, codes in lower case.

    Targets of one stock share a ledger and count in list order. `list_pos` gives that order; without such a column it
    is the reading order, which holds for a single file.
    """
    order = F.col("list_pos") if "list_pos" in listed.columns else F.monotonically_increasing_id()
    renamed = listed.withColumn("list_pos", order.cast("long")).withColumnsRenamed(TARGET_HEADERS)
    return renamed.select(
        F.to_date(F.col("breakthrough_date").cast("string"), "yyyyMMdd").alias("breakthrough_date"),
        F.lower("stock_code").alias("stock_code"),
        "stock_name",
        F.col("adj_stock_price").cast("double").alias("adj_stock_price"),
        "list_pos",
    )
