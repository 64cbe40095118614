"""Derived bars and statements as vendor CSV files, one per stock, to be read back by the import jobs.

Tasks write the files of their stocks where Arrow knows the store. Elsewhere Spark writes a folder of lines per stock, and
the driver renames its files to the vendor's layout, one after the other.
"""

from __future__ import annotations

from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlemill.schemas import BAR_HEADERS, BAR_SCHEMA, FINANCE_HEADER_SUFFIX, FINANCE_TEXT
from candlemill.sources.csv_files import FINANCE_ENDING
from candlemill.sources.shared import new_folder, shuffles_removed

BANNER = "每日行情, daily bars"
#: A stock's number within its code decides about its file; the same expression runs on both engines.
STOCK_NUMBER = "cast(substr(stock_code, 6, 5) as integer)"
#: Of every nine stocks, which has a file in GB2312, one with records of several lines, and one with its columns reversed.
IN_GB2312, IN_LINES, REVERSED = 4, 5, 6
CHINESE = "浦发・"
#: Of every six stocks, what is wrong with its file; the others' files are right.
DAMAGES = {1: "missing headers", 2: "cannot read", 3: "neither", 4: "no rows"}


def _lines(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """(stock_code, line, at, text) of heads and rows together."""
    return heads.select("stock_code", "line", F.lit(None).cast("string").alias("at"), "text").unionByName(rows)


def _heads(table: DataFrame, header: Column, banner: str = BANNER) -> DataFrame:
    stocks = table.select("stock_code").distinct()
    lines = F.array(F.struct(F.lit(0).alias("line"), F.lit(banner).alias("text")), F.struct(F.lit(1).alias("line"), header.alias("text")))
    return stocks.select("stock_code", F.explode(lines).alias("head")).select("stock_code", "head.line", "head.text")


def _write(lines: DataFrame, in_gb2312: Column, name: str, target: str) -> str:
    """One file per stock; `target` is its path with {code} for the stock. Returns the folder."""
    spark = lines.sparkSession
    folder = new_folder(spark, name)
    charsets = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(charsets)
    spark.conf.set(charsets, "true")
    try:
        text = F.when(in_gb2312, F.encode("text", "GB2312")).otherwise(F.col("text").cast("binary"))
        dealt = lines.repartition("stock_code").sortWithinPartitions("stock_code", "line", "at")
        dealt = dealt.select("stock_code", F.coalesce(text, F.lit(b"")).alias("text"))
        where = _address(spark, folder)
        with shuffles_removed(spark):
            if where:
                _by_tasks(dealt, where, target)
            else:
                rough = new_folder(spark, f"{name}-rough")
                dealt.select("stock_code", F.col("text").cast("string").alias("value")).write.partitionBy("stock_code").text(rough)
                _rename(spark, rough, folder, target)
    finally:
        spark.conf.set(charsets, before)
    return folder


def _address(spark: SparkSession, folder: str) -> str | None:
    """The folder's full address where Arrow, and so a task, can write to its store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path)
    full = store.makeQualified(path).toUri()
    if full.getScheme() == "file":
        return f"file://{full.getPath()}"
    try:
        fs.FileSystem.from_uri(full.toString())
    except (pa.ArrowException, OSError):
        return None
    return full.toString()


def _by_tasks(lines: DataFrame, folder: str, target: str) -> None:
    """Each task writes the files of its stocks, whose lines come in a row; a file has its name once it is whole."""

    def write(batches):
        store, root = (fs.LocalFileSystem(), folder.removeprefix("file://")) if folder.startswith("file://") else fs.FileSystem.from_uri(folder)
        code = out = rough = None

        def close() -> None:
            out.close()
            path = f"{root}/{target.format(code=code)}"
            store.create_dir(path.rsplit("/", 1)[0])
            store.move(rough, path)

        for batch in batches:
            if not batch.num_rows:
                continue
            codes, text = batch.column(0), batch.column(1).cast(pa.large_binary())
            ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = text.buffers()[2]
            first = np.flatnonzero(np.concatenate(([True], pc.not_equal(codes[1:], codes[:-1]).to_numpy(zero_copy_only=False))))
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(codes)], strict=True):
                if codes[i].as_py() != code:
                    if out:
                        close()
                    code, rough = codes[i].as_py(), f"{root}/_{uuid4().hex}"
                    out = store.open_output_stream(rough)
                out.write(data[ends[i] : ends[j]])
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["done"])

    # The folder of rows without a stock has the name that Spark's writers give it.
    code = F.coalesce("stock_code", F.lit("__HIVE_DEFAULT_PARTITION__"))
    lines.select(code.alias("code"), F.concat("text", F.lit(b"\n")).alias("text")).mapInArrow(write, "done string").collect()


def _rename(spark: SparkSession, rough: str, folder: str, target: str) -> None:
    """The only file of each stock_code=... folder becomes the stock's vendor file."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(rough).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in store.globStatus(path(f"{rough}/stock_code=*/part-*")):
        code = found.getPath().getParent().getName().split("=", 1)[1]
        new = path(f"{folder}/{target.format(code=code)}")
        store.mkdirs(new.getParent())
        store.rename(found.getPath(), new)
    store.delete(path(rough), True)


def _cells(bars: DataFrame) -> list[Column]:
    """Cells in the order of the headers. Columns the derived bars lack are empty; membership flags follow the volume."""
    number = F.expr(STOCK_NUMBER)
    cells = []
    for field in BAR_SCHEMA.fields:
        if field.name in bars.columns:
            cell = F.coalesce(F.col(field.name).cast("string"), F.lit(""))
            if field.name == "stock_name":
                cell = F.when(number % 9 == IN_GB2312, F.concat(F.lit(CHINESE), cell)).otherwise(cell)
            if field.name == "industry_level2":
                quoted = F.concat(F.lit('"'), F.replace(cell, F.lit(" "), F.lit("\n")), F.lit('"'))
                cell = F.when(number % 9 == IN_LINES, quoted).otherwise(cell)
            cells.append(cell)
        elif field.name.endswith("_component"):
            cells.append(F.when(F.pmod("volume", F.lit(2.0)) == 0, "True").otherwise("False"))
        else:
            cells.append(F.lit(""))
    return cells


def write_bar_files(bars: DataFrame) -> str:
    """Each stock's bars as banner, header and rows, in both encodings, with records of several lines and other orders."""
    number = F.expr(STOCK_NUMBER)
    cells = _cells(bars)
    text = F.when(number % 9 == REVERSED, F.concat_ws(",", *reversed(cells))).otherwise(F.concat_ws(",", *cells))
    rows = bars.select("stock_code", F.lit(2).alias("line"), F.col("trade_date").cast("string").alias("at"), text.alias("text"))
    names = list(BAR_HEADERS)
    header = F.when(number % 9 == REVERSED, F.lit(",".join(reversed(names)))).otherwise(F.lit(",".join(names)))
    return _write(_lines(rows, _heads(bars, header)), number % 9 == IN_GB2312, "bar-files", "{code}.csv")


def write_damaged_bar_files(bars: DataFrame) -> str:
    """As above in UTF-8, but for `DAMAGES`: a header without its last name, a row with a word for a price, a row with
    bytes of neither encoding, no rows at all."""
    number = F.expr(STOCK_NUMBER) % 6
    names = list(BAR_HEADERS)
    header = F.when(number == 1, F.lit(",".join(names[:-1]))).otherwise(F.lit(",".join(names)))
    rows = bars.select("stock_code", F.lit(2).alias("line"), F.col("trade_date").cast("string").alias("at"), F.concat_ws(",", *_cells(bars)).alias("text"))
    rows = rows.where(number != 4)
    price = [("ten" if h == "收盘价" else "2020-01-02" if h == "交易日期" else "") for h in names]
    more = F.when(number == 2, F.lit(",".join(price))).when(number == 3, F.unhex(F.lit("41FF2C42FF")).cast("string"))
    last = bars.select("stock_code").distinct().select("stock_code", F.lit(3).alias("line"), F.lit(None).cast("string").alias("at"), more.alias("text"))
    return _write(_lines(rows.unionByName(last.where("text is not null")), _heads(bars, header)), F.lit(False), "damaged-files", "{code}.csv")


def write_statement_files(finance: DataFrame) -> str:
    """Each stock's statements as `{code}/{code}_一般企业.csv`, every third file in UTF-8, every fifth with another order
    of columns and one column more, which holds a word."""
    number = F.expr(STOCK_NUMBER)
    names = finance.columns
    cell = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    headed = lambda order: ",".join(n if n in FINANCE_TEXT[:1] else f"{n}{FINANCE_HEADER_SUFFIX}" for n in order)
    other = [*reversed(names)]
    text = F.when(number % 5 == 0, F.concat_ws(",", *map(cell, other), F.lit("无"))).otherwise(F.concat_ws(",", *map(cell, names), F.lit("")))
    rows = finance.select("stock_code", F.lit(2).alias("line"), F.col("report_date").alias("at"), text.alias("text"))
    header = F.when(number % 5 == 0, F.lit(headed(other) + ",R_note@xbx")).otherwise(F.lit(headed(names) + ",抓取时间"))
    return _write(_lines(rows, _heads(finance, header)), number % 3 != 0, "statement-files", "{code}/{code}" + FINANCE_ENDING)
