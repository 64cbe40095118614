"""Entry sizing and the ordered exit rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlemill.functions import safe_div, whole_lots
from candlemill.operators.keyed import KEY, nearest
from candlemill.params import TradeParams

# Fixed values of the exit rules.
STOP_SHARE = 0.95
FIRST_RUNG = 1.10
RUNGS = (1.20, 1.30, 1.40, 1.50, 1.60, 1.70, 1.80, 1.90)
DOUBLE = 2.00
WEAK_CLOSES = 4


def size_entries(numbered: DataFrame, targets: DataFrame, trade: TradeParams) -> DataFrame:
    """Enter each target on its stock's first limited bar after the breakthrough: half the cash at the open, half at
    the close, in lots of one hundred. `support` is the support price of the stock's first limited bar.
    """
    bars = numbered.select(KEY, "trade_date", F.struct(
        F.col("pos").alias("entry_pos"), F.col("trade_date").alias("bought_date"),
        F.col("adj_open").alias("entry_open"), F.col("adj_close").alias("entry_close"),
    ).alias("entry"))
    entry = nearest(targets, bars, ("breakthrough_date", "trade_date"), "entry", forward=True)
    support = numbered.filter(F.col("pos") == 1).select(KEY, F.col("adj_support_price").alias("support"))
    half = trade.initial_cash * 0.5
    at_open, at_close = F.col("shares_at_open"), F.col("shares_at_close")
    return (
        targets.select(KEY, "stock_name", "breakthrough_date", "list_pos")
        .join(entry.filter(F.col("entry").isNotNull()), [KEY, "breakthrough_date"])
        .join(support, KEY)
        .select("*", "entry.*")
        .drop("entry")
        .withColumns({
            "shares_at_open": whole_lots(half, F.col("entry_open")),
            "shares_at_close": whole_lots(half, F.col("entry_close")),
        })
        .withColumns({
            "total_shares": at_open + at_close,
            "cost": at_open * F.col("entry_open") + at_close * F.col("entry_close"),
        })
        .withColumn("cost_price", safe_div(F.col("cost"), F.col("total_shares")))
        .withColumn("stop_price", F.col("cost_price") * STOP_SHARE)
    )


def holding_bars(entries: DataFrame, numbered: DataFrame, trade: TradeParams) -> DataFrame:
    """Add to each entry the array `bars` of its stock's bars from the entry bar on, one more than may be held.

    Bars are gathered in blocks of that many positions. A block also takes the bars of the next one, so an entry finds
    all its bars under one key and no group outgrows two blocks.
    """
    size = trade.max_holding_days + 1
    block = F.floor((F.col("pos") - 1) / size)
    entered = entries.withColumn("block", F.floor((F.col("entry_pos") - 1) / size))
    # Of the bars only those of blocks some entry reads are gathered.
    read = entered.select(KEY, "block").distinct()
    blocks = (
        numbered.select(
            KEY,
            F.explode(F.array(block, block - 1)).alias("block"),
            F.struct(
                "pos", F.col("trade_date").alias("day"), F.col("adj_high").alias("high"),
                F.col("adj_low").alias("low"), F.col("adj_close").alias("close"),
            ).alias("bar"),
        )
        .join(read, [KEY, "block"], "left_semi")
        .groupBy(KEY, "block")
        .agg(F.array_sort(F.collect_list("bar")).alias("bars"))
    )
    held = F.filter("bars", lambda b: b["pos"].between(F.col("entry_pos"), F.col("entry_pos") + size - 1))
    return (
        entered.join(blocks, [KEY, "block"])
        .withColumn("bars", held)
        .drop("block")
    )


def apply_exit_rules(entries: DataFrame, numbered: DataFrame, trade: TradeParams) -> DataFrame:
    """Follow each position bar by bar to its exit and add the sale of its first half and its final sale.

    A position needs no other position: what targets of one stock share is summed up in the ledger. So the positions of
    an Arrow batch advance together, one holding day per step, however many targets a stock has.
    """
    rows = holding_bars(entries, numbered, trade)
    kept = [f for f in rows.schema.fields if f.name != "bars"]
    sales = [
        T.StructField(f"{sale}_{part}", kind)
        for sale in ("half", "exit")
        for part, kind in (
            ("day", T.IntegerType()), ("date", T.DateType()), ("shares", T.DoubleType()),
            ("price", T.DoubleType()), ("bar_close", T.DoubleType()),
        )
    ]
    schema = T.StructType([*kept, *sales])
    limit = trade.max_holding_days

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _follow(batch, limit)
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in kept] + [found[f.name] for f in sales], names=schema.names
            )

    return rows.mapInArrow(follow, schema)


def _follow(batch: pa.RecordBatch, limit: int) -> dict[str, pa.Array]:
    """Walk all positions of a batch through their holding days."""
    n, width = batch.num_rows, limit + 1
    bars = batch.column("bars")
    lengths = pc.list_value_length(bars).to_numpy(zero_copy_only=False).astype(int)
    slots = np.arange(width) < lengths[:, None]

    def grid(name: str, kind: type = float) -> np.ndarray:
        out = np.full((n, width), np.nan if kind is float else 0, dtype=kind)
        values = bars.flatten().field(name)
        values = values.cast(pa.int32()) if kind is int else values
        out[slots] = values.to_numpy(zero_copy_only=False)
        return out

    high, low, close, day_of = grid("high"), grid("low"), grid("close"), grid("day", int)
    cost, support, shares = (
        batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("cost_price", "support", "total_shares")
    )
    stop, max_rise = cost * STOP_SHARE, np.ones(n)
    half, weak = np.zeros(n, bool), np.zeros(n, int)
    open_ = shares > 0
    sold = {
        f"{sale}_{part}": np.full(n, np.nan)
        for sale in ("half", "exit") for part in ("day", "date", "shares", "price", "bar_close")
    }

    def sell(sale: str, who: np.ndarray, t: int, price: np.ndarray, amount: np.ndarray, bar: int) -> None:
        for part, value in (
            ("day", np.full(n, t + 1)), ("date", day_of[:, t]), ("shares", amount),
            ("price", price), ("bar_close", close[:, bar]),
        ):
            sold[f"{sale}_{part}"][who] = value[who]

    def leave(who: np.ndarray, t: int, price: np.ndarray, bar: int | None = None) -> None:
        sell("exit", who, t, price, shares, t if bar is None else bar)
        open_[who] = False

    for t in range(width):
        here = open_ & slots[:, t]
        if t == limit:
            # Beyond the last holding day the position was sold at the close of the day before.
            leave(here, t - 1, close[:, t - 1], t)
            break
        leave(here & (low[:, t] < stop), t, stop)
        here &= open_
        under = here & (low[:, t] < support)
        weak[here & ~under] = 0
        weak[under & (close[:, t] >= support)] = 0
        weak[under & ~(close[:, t] >= support)] += 1
        leave(under & (weak >= WEAK_CLOSES), t, close[:, t])
        here &= open_
        rise = high[:, t] / cost
        first = here & ~half & (rise >= FIRST_RUNG)
        sell("half", first, t, cost * FIRST_RUNG, shares * 0.5, t)
        shares[first] *= 0.5
        half[first] = True
        stop[first] = (cost * FIRST_RUNG)[first]
        max_rise[first] = FIRST_RUNG
        higher = here & half & (rise > max_rise)
        climbing = higher.copy()
        for rung in RUNGS:
            # At most one rung a day: the lowest above the highest one reached so far.
            onto = climbing & (max_rise < rung) & (rise >= rung)
            max_rise[onto] = rung
            stop[onto] = (cost * rung)[onto]
            climbing &= ~onto
        leave(higher & (rise >= DOUBLE), t, cost * DOUBLE)
        here &= open_
        leave(here & half & (close[:, t] < stop), t, stop)
        here &= open_
        leave(here & half & (max_rise >= rise) & (t + 1 >= limit), t, close[:, t])
        here &= open_
        leave(here & (lengths == t + 1), t, close[:, t])

    kinds = {"day": pa.int32(), "date": pa.date32()}
    return {name: _column(values, kinds.get(name.split("_", 1)[1])) for name, values in sold.items()}


def _column(values: np.ndarray, kind: pa.DataType | None) -> pa.Array:
    """Arrow column with NULL for the sales that did not happen."""
    column = pa.array(values, from_pandas=True)
    return column if kind is None else column.cast(pa.int32()).cast(kind)
