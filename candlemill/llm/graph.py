"""Connected components of links between ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.llm.scratch import Scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    other = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return other.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links lead to, for every id in a link of two different ids.

    `links` has two integer columns. Alternating star contraction: each round halves distances to the smallest id, all
    steps are joins and grouped minima, and a round's edges are written and never exceed twice the links.
    """
    a, b = links.columns
    edges = scratch.keep(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "links")
    mark = None
    while mark != (now := _mark(edges)):
        mark = now
        if now[0] == 0:
            break
        wide = scratch.keep(_large_star(edges), "links")
        scratch.drop(edges)
        edges = scratch.keep(_small_star(wide), "links")
        scratch.drop(wide)
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
