"""Mixing sources to target weights by entropy balancing.

The mix takes document d `r_d` times on average. Of all rates that give every source its target number of words, the
chosen ones are closest to 1 in relative entropy, weighted by words. Their dual has one multiplier per source, rates are
`exp(multiplier)`, and Newton iterations on the dual find the multipliers; each is an aggregation over the corpus, whose
rows were first added up by source and size. Rates become whole copies: everyone gets the whole part, and one copy more
goes to so many documents of each size that the words taken follow the target size by size, from the largest down, which
leaves an error of a few words where a source has small documents. Hashes of doc_id choose the documents of a size.

A null source is a source of its own and comes last. Null and empty texts have size 0, rate and copies of their source.
Repeated rows are mixed one by one. Sources without words have the target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlemill.llm.scratch import Scratch
from candlemill.llm.words import count_words

#: Hash ranges that documents of one source and size are dealt into, so that none of these groups needs one task.
SPLITS = 256
NEWTON_STEPS = 60
CLOSE = 1e-12


def with_sizes(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(row, source, size): the given columns as a struct, and the words of the text."""

    def count(batches):
        for batch in batches:
            sizes = pa.array(count_words(batch.column(2)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes], ["row", "source", "size"])

    chosen = docs.select(F.struct(*columns).alias("row"), F.col("source").cast("string").alias("source"), "text")
    kind = chosen.schema["row"].dataType.simpleString()
    return chosen.mapInArrow(count, f"row {kind}, source string, size long")


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """(source, source_size, target): all words shared by weight, no source above `cap` times its own.

    `sizes` has a row per source. Sources in code-point order take the weights in turn. A source is held at its cap
    when its cap per weight is below the level to which the others are filled up.
    """
    total = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), place % len(weights))
    sizes = sizes.withColumn("w", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("most") / F.col("w"), "source")
    up_to = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(total) - F.coalesce(F.sum("most").over(up_to), F.lit(0.0))
    level = left / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    sizes = sizes.withColumn("level", F.when(F.col("most") / F.col("w") >= level, level))
    level = F.max("level").over(total)  # of the first source that is not held at its cap
    return sizes.select("source", "source_size", F.least("most", F.coalesce(level * F.col("w"), "most")).alias("target"))


def rates(strata: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, rate): Newton iterations on the dual of the balancing problem, one aggregation of all strata each."""
    found = targets.select("source", "target", F.lit(0.0).alias("dual"))
    for _ in range(NEWTON_STEPS):
        tilted = strata.join(found, F.col("strata_source").eqNullSafe(F.col("source")))
        given = F.sum(F.col("n") * F.col("size") * F.exp("dual"))
        # The gradient is given - target, and so is the only entry of the Hessian that belongs to the source: given.
        moved = F.when((given > 0) & (F.first("target") > 0), F.first("dual") - F.least(F.lit(1.0), F.greatest(F.lit(-2.0), 1 - F.first("target") / given))).otherwise(F.lit(0.0))
        off = F.when(given > 0, F.abs(given - F.first("target")) / F.greatest(F.first("target"), F.lit(1.0))).otherwise(0.0)
        found = scratch.keep(tilted.groupBy("source").agg(F.first("target").alias("target"), moved.alias("dual"), off.alias("off")), "dual")
        if (found.agg(F.max("off")).first()[0] or 0.0) <= CLOSE:
            break
    return found.select("source", F.when(F.col("target") > 0, F.exp("dual")).otherwise(0.0).alias("rate"))


def _round_sizes(cap: float):
    def follow(sizes: pd.DataFrame) -> pd.DataFrame:
        sizes = sizes.sort_values("size", ascending=False)
        size, n = sizes["size"].to_numpy(), sizes["n"].to_numpy()
        rate = min(float(sizes["rate"].iloc[0]), cap)
        whole = int(rate + 1e-9)
        part = max(0.0, rate - whole)
        want = np.cumsum(part * size * n)
        more, taken = np.zeros(len(size), np.int64), 0.0
        for i in range(len(size)):
            share = (want[i] - taken) / size[i] if size[i] else part * n[i]
            more[i] = min(max(round(share), 0), n[i])
            taken += float(more[i] * size[i])
        return pd.DataFrame({"source": sizes["source"], "size": size, "whole": whole, "more": more})

    return follow


def mix_sources(docs: DataFrame, columns: Sequence[str] = ("doc_id",), weights: Sequence[float] = (1, 2, 3), cap: float = 3) -> DataFrame:
    """The given columns of all documents as a struct `row`, with source, size, source_size, target, rate and copies.

    `columns` must hold doc_id. `target` is the source's; `copies` is how often the mix takes the document.
    """
    scratch = Scratch(docs.sparkSession)
    bucket = F.pmod(F.xxhash64("row.doc_id"), F.lit(SPLITS)).alias("bucket")
    sized = scratch.keep(with_sizes(docs, columns).withColumn("bucket", bucket), "sized")
    cells = scratch.keep(sized.groupBy("source", "size", "bucket").agg(F.count("*").alias("n")), "cells")
    strata = scratch.keep(cells.groupBy(F.col("source").alias("strata_source"), "size").agg(F.sum("n").alias("n")), "strata")
    targets = scratch.keep(source_targets(strata.groupBy(F.col("strata_source").alias("source")).agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, cap), "targets")
    rate = rates(strata, targets, scratch)
    rated = strata.join(rate, F.col("strata_source").eqNullSafe(F.col("source"))).select("source", "size", "n", "rate")
    rounded = rated.groupBy("source").applyInPandas(_round_sizes(cap), "source string, size long, whole long, more long").withColumnsRenamed({"source": "s", "size": "z"})
    # Documents of a source and size stand in the order of their hash ranges; the first `more` get one copy more.
    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("before", F.coalesce(before, F.lit(0)))
    cells = cells.join(rounded, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    cells = cells.join(targets.withColumnRenamed("source", "t").join(rate.withColumnRenamed("source", "q"), F.col("t").eqNullSafe(F.col("q"))), F.col("s").eqNullSafe(F.col("t")))
    plan = scratch.keep(cells.select("s", "z", F.col("bucket").alias("b"), "before", "whole", "more", "source_size", "target", "rate"), "plan")
    both = sized.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("bucket") == F.col("b")))
    place = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy(F.xxhash64("row.doc_id"), "row.doc_id"))
    copies = F.col("whole") + (F.col("before") + place <= F.col("more")).cast("int")
    return both.select("row", "source", "size", "source_size", "target", "rate", copies.alias("copies"))
