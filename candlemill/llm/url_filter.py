"""URL filters by a cascade of Bloom filters, in DataFrame functions only.

Rules name a host and the start of a path; a rule fits its host and all its subdomains, and the longest rule that fits
decides. Every URL has a few keys that might be rules: its host's suffixes with as many labels as some rule has, joined
to the path's beginnings as long as some rule's. The keys of all URLs are the universe.

Level 1 of a cascade is a Bloom filter of the listed keys. Level 2 encodes the keys of the universe that pass level 1
without being listed, level 3 the listed keys that pass level 2, and so on until no key is left. Following a key down
gives its membership exactly for every key of the universe, by arithmetic on the URL's own row. A second cascade over
the listed keys tells those that block from those that allow. Filters are a few bits per listed key whatever the corpus
has: level 1 is sized by the number of keys in the universe, so that about as many false positives as listed keys
remain.

URLs that are null or have no `://` have an empty host and path and fit no rule. Rows may repeat; a null id is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A filter travels in the plan; lists that need more bits than this are refused.
MOST_BITS = 1 << 23


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str  # empty, or from its first slash on


class Level(NamedTuple):
    bits: int
    hashes: int
    seed: int
    words: list[int]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def candidates(host: Column, path: Column, rules: Iterable[Rule]) -> Column:
    """The keys of a URL, as structs of length, length of the host and key."""
    labels = F.split(host, r"\.", -1)
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})
    keys = []
    for count, length in shapes:
        suffix = F.array_join(F.slice(labels, -count, count), ".")
        key = F.concat(suffix, F.substring(path, 1, length))
        fits = (F.size(labels) >= count) & (F.length(path) >= length)
        keys.append(F.when(fits, F.struct(F.length(key).alias("length"), F.length(suffix).alias("host"), key.alias("key"))))
    return F.array_compact(F.array(*keys))


def _places(key: Column, level: Level) -> list[Column]:
    half = F.lit(1 << 31)  # sums of these do not overflow
    one = F.pmod(F.xxhash64(F.lit(level.seed), key), half)
    two = F.pmod(F.xxhash64(F.lit(~level.seed), key), half).bitwiseOR(F.lit(1))
    return [F.pmod(one + two * F.lit(i), F.lit(level.bits).cast("long")) for i in range(level.hashes)]


def _passes(key: Column, level: Level) -> Column:
    words = F.lit(level.words).cast("array<bigint>")
    test = F.lit(True)
    for place in _places(key, level):
        word = F.get(words, F.floor(place / 64).cast("int"))
        test = test & (F.call_function("getbit", word, (place % 64).cast("int")) == 1)
    return test


def _level(keys: DataFrame, count: int, hashes: int, seed: int) -> Level:
    bits = 64 * max(1, math.ceil(count * hashes / math.log(2) / 64))
    if bits > MOST_BITS:
        raise ValueError(f"a filter of {bits} bits is needed, more than {MOST_BITS}; list fewer keys")
    level = Level(bits, hashes, seed, [])
    place = F.explode(F.array(*_places(F.col("key"), level)))
    words = keys.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).cast("int").alias("w"))
    found = words.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("bits")).collect()
    held = dict(found)
    return level._replace(words=[held.get(i, 0) for i in range(bits // 64)])


def build_cascade(universe: DataFrame, listed: DataFrame) -> list[Level]:
    """Levels that tell the keys of `listed` from all other keys of `universe`; both have a column `key`."""
    listed = listed.select("key").distinct()
    r = listed.count()
    if not r:
        return []
    s = universe.agg(F.approx_count_distinct("key")).first()[0]
    levels = [_level(listed, r, max(1, math.ceil(math.log2(max(2.0, s / r)))), 1)]
    inside, outside = listed, universe.where(_passes(F.col("key"), levels[0])).join(listed, "key", "left_anti").distinct()
    while count := outside.count():
        # The keys told so far are few: about as many as are listed, then half as many from level to level.
        levels.append(_level(outside, count, 1, len(levels) + 1))
        inside, outside = outside, inside.where(_passes(F.col("key"), levels[-1]))
    return levels


def in_cascade(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed."""
    answer = F.lit(len(levels) % 2 == 1)
    for depth in range(len(levels) - 1, -1, -1):
        answer = F.when(_passes(key, levels[depth]), answer).otherwise(F.lit(depth % 2 == 1))
    return answer


def judge_urls(pages: DataFrame, rules: list[Rule], otherwise: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict): the longest rule that fits, else null and `otherwise`."""
    spark: SparkSession = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    if not rules:
        return pages.select("page_id", host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    keyed = parts.withColumn("keys", candidates(F.col("host"), F.col("path"), rules))
    universe = keyed.select(F.explode("keys.key").alias("key"))
    table = spark.createDataFrame([(r.host + r.path, r.verdict) for r in rules], "key string, verdict string")
    members = build_cascade(universe, table)
    blocked = build_cascade(table, table.where("verdict = 'block'"))
    found = F.array_max(F.filter("keys", lambda k: in_cascade(k["key"], members)))
    judged = keyed.select("page_id", "host", "path", found["key"].alias("rule"))
    verdict = F.when(F.col("rule").isNull(), otherwise).when(in_cascade(F.col("rule"), blocked), "block").otherwise("allow")
    return judged.withColumn("verdict", verdict)
