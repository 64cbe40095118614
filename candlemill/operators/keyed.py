"""Ordered work per stock that also holds when one stock has too many rows for a task.

Most stocks fit a task, so their windows run on one hash exchange by `stock_code`. The stocks `find_hot` reports go
through the same operators with `split=True`. There rows are range partitioned over all their columns in order, every
row gets its exact number, and windows that look a fixed number of rows back run on fixed-size segments which start
with copies of the rows they look back to. `by_size` parts the bars once and joins the results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import accumulate
from math import ceil

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from candlemill.sources.shared import keep

KEY = "stock_code"
HOT_ROWS = 4_000_000
SEGMENT_ROWS = 500_000
#: Rows of an exchange by stock that a task gets on average, whatever the table's size.
TASK_ROWS = 100_000
#: Rows up to which a window function looks through a sliding frame.
SLIDING_ROWS = 64
_PART, _SEGMENT, _COPY = "_part", "_segment", "_copy"


def find_hot(df: DataFrame, limit: int = HOT_ROWS) -> DataFrame | None:
    """Stocks with more than `limit` rows, or None. Reads the code column only and counts before the shuffle."""
    hot = df.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > limit).select(KEY)
    return None if hot.isEmpty() else keep(hot, "hot_stocks")


def tasks_for(df: DataFrame) -> int:
    """Into how many parts an exchange deals the rows, so that what a task holds does not grow with the table.

    Spark's own choice goes by compressed bytes, up to 64 MB of them a task: over half a gigabyte of sorted bars.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, ceil(df.count() / TASK_ROWS))


def row_hash(df: DataFrame, *leaving_out: str) -> Column:
    """Hash of a row's other columns. Hashes pass over NULL, so which columns are NULL goes in as well."""
    names = [c for c in df.columns if c not in leaving_out]
    return F.xxhash64(*names, *(F.isnull(c) for c in names))


def by_size(df: DataFrame, hot: DataFrame | None, chain: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """Run a chain of operators, called with rows and `split`, once on the hot stocks and once on all others."""
    if hot is None:
        return chain(df, False)
    return chain(df.join(hot, KEY, "left_anti"), False).unionByName(chain(df.join(hot, KEY, "left_semi"), True))


def number_rows(df: DataFrame, order: Sequence[str], name: str, key: str | None = None) -> DataFrame:
    """Number the rows 1..n in `order`, per `key` when given, with no task holding more than one range of them.

    `order` must start with the key. A range partition is a run of consecutive rows, so a row's number is its number
    within the part plus the sizes of the earlier parts, of which there is one per key and part. The ranged rows are written, because the parts must not move between
    the two readings.
    """
    by = [key] if key else []
    parts = keep(df.repartitionByRange(*order).withColumn(_PART, F.spark_partition_id()), "ranges")
    sizes = parts.groupBy(*by, _PART).agg(F.count(F.lit(1)).alias("_n"))
    if key:
        earlier = Window.partitionBy(key).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select(key, _PART, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    else:
        # One row per task of the job, which the driver holds anyway.
        counted = sorted(tuple(r) for r in sizes.collect())
        before = accumulate((n for _, n in counted), initial=0)
        offsets = df.sparkSession.createDataFrame([(part, b) for (part, _), b in zip(counted, before, strict=False)], f"{_PART} int, _before long")
    inside = F.row_number().over(Window.partitionBy(*by, _PART).orderBy(*order))
    numbered = parts.join(offsets, [*by, _PART]).withColumn(name, (inside + F.col("_before")).cast("long"))
    return numbered.drop(_PART, "_before")


def windowed(
    df: DataFrame,
    order: Sequence[str],
    back: int,
    build: Callable[[DataFrame, WindowSpec, WindowSpec], DataFrame],
    number: str,
    split: bool = False,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Number each stock's rows in `order` and add the window columns of `build`, which look at most `back` rows back.

    `build` gets the numbered rows, the window of a stock or of a segment, and the same window backwards.
    """

    if not split:
        window = Window.partitionBy(KEY).orderBy(*order)
        numbered = df.withColumn(number, F.row_number().over(window).cast("long"))
        return build(numbered, window, Window.partitionBy(KEY).orderBy(F.desc(number)))
    size = max(segment_rows, back)
    numbered = number_rows(df, [KEY, *order], number, KEY)
    first = F.floor((F.col(number) - 1) / size)
    last = F.floor((F.col(number) - 1 + back) / size)
    copies = numbered.withColumn(_SEGMENT, F.explode(F.sequence(first, last))).withColumn(
        _COPY, F.col(_SEGMENT) != first
    )
    window, backwards = (Window.partitionBy(KEY, _SEGMENT).orderBy(order) for order in (F.asc(number), F.desc(number)))
    return build(copies, window, backwards).filter(~F.col(_COPY)).drop(_SEGMENT, _COPY)


def highest_before(value: Column, number: str, bars: int, window: WindowSpec, backwards: WindowSpec) -> Column:
    """The largest non-null `value` of the `bars` rows before each row.

    A frame that slides is looked through anew for every row, which is the cheapest way for few rows. For more than
    SLIDING_ROWS the cost per row is the same whatever their number: cut the rows into blocks of `bars`; those before a
    row then make up the end of one block and the beginning of the next, and frames that only grow hold both. Among
    pairs (block, value) the largest has the latest block, so the largest pair so far is the maximum from the beginning
    of the current block on, and backwards, which takes a second sort, that to the end of a block.
    """
    if bars <= SLIDING_ROWS:
        return F.max(value).over(window.rowsBetween(-bars, -1))
    block = F.floor((F.col(number) - 1) / bars).cast("int")
    begun = F.max(F.struct(block.alias("block"), value.alias("value"))).over(window.rowsBetween(Window.unboundedPreceding, -1))
    ended = F.max(F.struct((-block).alias("block"), value.alias("value"))).over(backwards.rowsBetween(Window.unboundedPreceding, bars))
    # Null counts as the smallest, but greatest() passes over it.
    return F.when(F.col(number) > bars, F.greatest(begun["value"], ended["value"])).otherwise(begun["value"])


def nearest(left: DataFrame, right: DataFrame, on: tuple[str, str], value: str, forward: bool = False) -> DataFrame:
    """As-of lookup per stock: the distinct (stock, date) pairs of `left` with the value of the nearest date of `right`.

    Backward takes the last date not after the left one, forward the first date after it; both rely on `value` rising
    with the date. Pairs are merged and scanned once, never joined with each other, and hold one row per calendar
    date and stock, so a window stays short whatever the number of rows behind it.
    """
    points = left.select(KEY, on[0]).distinct()
    return _scan(points, right, on, value, forward)


def with_nearest(
    left: DataFrame, right: DataFrame, on: tuple[str, str], value: str, split: bool = False
) -> DataFrame:
    """Every row of `left` with the backward as-of value."""
    if not split:
        return _scan(left, right, on, value)
    points = keep(left, "hot_points")
    return points.join(nearest(points, right, on, value), [KEY, on[0]], "left")


def _scan(points: DataFrame, right: DataFrame, on: tuple[str, str], value: str, forward: bool = False) -> DataFrame:
    point_date, value_date = on
    pick = F.min if forward else F.max
    values = right.groupBy(KEY, F.col(value_date).alias("_day")).agg(pick(value).alias(value))
    merged = points.withColumns({"_day": F.col(point_date), "_point": F.lit(1)}).unionByName(
        values.withColumn("_point", F.lit(0)), allowMissingColumns=True
    )
    # A value on the very date of a point counts backward and does not count forward, hence the order within a date.
    order = (F.col("_day").desc(), F.col("_point").desc()) if forward else (F.col("_day"), F.col("_point"))
    seen = Window.partitionBy(KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return merged.withColumn(value, pick(value).over(seen)).filter(F.col("_point") == 1).drop("_day", "_point")
