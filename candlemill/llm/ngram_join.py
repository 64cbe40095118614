"""N-gram Jaccard join: documents whose sets of word shingles are similar, by a grouped prefix join.

Steps, each a Spark job over written tables:

1. A count sketch of fixed size gives every shingle a rough frequency. It only sets an order in which rare shingles
   come first; any order gives the same result.
2. Documents with equal shingle sets form a class, of which one document goes on.
3. A class's prefix is its first `n - ceil(t n) + 1` shingles in that order: two sets of similarity t share one.
   Classes with the same prefix and size collapse into one group, and only groups are joined.
4. Group pairs that share a prefix shingle pass size and position filters. Two rounds first compare each group only with
   one hub per shingle, so that thousands of near copies are linked by a star rather than by all their pairs. Then all
   pairs of groups that these links have not yet put together are compared: no link between different components is lost.
5. Group pairs expand to their members, a parity bitmap bounds their overlap, and what is left is verified on whole sets.
6. Components of the verified links.

Null and empty texts have an empty set and no link. Texts of less than k words have one shingle. Repeated doc_ids count
as one document with one of their sets; a row with a null doc_id takes the class and component of an equal set with a
doc_id, and has none otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.llm.graph import components
from candlemill.llm.scratch import Scratch, small_batches
from candlemill.llm.words import U, mix, shingles, split_words

CHUNK = 1 << 14
#: Bits of a document's parity bitmap, and of the filter that tells which documents' sets a verification needs.
MAP_BITS = 1024
WANTED_BITS = 1 << 23
CARD = "doc_id long, n long, k1 long, k2 long, prefix array<long>, prefix_key long, bitmap array<long>"


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for words in split_words(texts):
        for row, found in shingles(words, k):
            found = np.sort(found)
            if len(found):
                found = found[np.concatenate(([True], found[1:] != found[:-1]))]
            yield row, found


def shingle_counts(docs: DataFrame, k: int, bits: int) -> np.ndarray:
    """Documents per bucket of shingle hashes. The table has 2**bits counters, whatever the corpus."""

    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            held: list[np.ndarray] = []
            for _, found in _sets(batch.column(0), k):
                held.append(found >> U(64 - bits))
                if len(held) >= 2000:
                    total += np.bincount(np.concatenate(held).astype(np.int64), minlength=1 << bits)
                    held = []
            if held:
                total += np.bincount(np.concatenate(held).astype(np.int64), minlength=1 << bits)
        step = min(CHUNK, 1 << bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total) // step), pa.int64()), pa.array([x.astype("<i8").tobytes() for x in total.reshape(-1, step)], pa.binary())],
            ["chunk", "counts"],
        )

    def add(key, batches):
        total = sum(np.frombuffer(x.as_py(), "<i8") for batch in batches for x in batch.column("counts"))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["chunk", "counts"])

    def add_batches(key, table):
        return pa.Table.from_batches(list(add(key, table.to_batches())))

    parts = docs.select("text").mapInArrow(count, "chunk long, counts binary").groupBy("chunk").applyInArrow(add_batches, "chunk long, counts binary")
    found = {row.chunk: np.frombuffer(row.counts, "<i8") for row in parts.toLocalIterator()}
    step = min(CHUNK, 1 << bits)
    return np.concatenate([found.get(c, np.zeros(step, np.int64)) for c in range((1 << bits) // step)])


def cards(docs: DataFrame, k: int, percent: int, ranks, bits: int) -> DataFrame:
    """A row per document: size, a key of the whole set, prefix in rare-first order, key of the prefix, parity bitmap."""

    def make(batches):
        rank = ranks.value
        for batch in batches:
            ids = batch.column(0)
            rows, sizes, one, two, prefixes, keys, maps = [], [], [], [], [], [], []
            for row, found in _sets(batch.column(1), k):
                n = len(found)
                key = (rank[found >> U(64 - bits)].astype(U) << U(56)) | (found >> U(8))
                key = np.sort(key)[: n - (n * percent + 99) // 100 + 1] if n else key
                flips = np.bincount((found & U(MAP_BITS - 1)).astype(np.int64), minlength=MAP_BITS) & 1
                rows.append(row)
                sizes.append(n)
                one.append(int(np.bitwise_xor.reduce(mix(found)).view(np.int64)) if n else 0)
                two.append(int(np.add.reduce(mix(found ^ U(0xA5A5A5A5A5A5A5A5))).view(np.int64)) if n else 0)
                prefixes.append(key.view(np.int64))
                keys.append(int(np.add.reduce(mix(key)).view(np.int64)) if n else 0)
                maps.append(np.packbits(flips.astype(np.uint8)).view("<i8") if n else np.zeros(MAP_BITS // 64, np.int64))
                if len(rows) >= 2000:
                    yield _card_batch(ids, rows, sizes, one, two, prefixes, keys, maps)
                    rows, sizes, one, two, prefixes, keys, maps = [], [], [], [], [], [], []
            if rows:
                yield _card_batch(ids, rows, sizes, one, two, prefixes, keys, maps)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(make, CARD)


def _list(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays), pa.int64()))


def _card_batch(ids, rows, sizes, one, two, prefixes, keys, maps) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(rows)), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), _list(prefixes), pa.array(keys, pa.int64()), _list(maps)],
        ["doc_id", "n", "k1", "k2", "prefix", "prefix_key", "bitmap"],
    )


def wanted_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size in which every id of the table has a bit."""
    place = F.pmod(F.xxhash64("id"), F.lit(WANTED_BITS))
    words = ids.groupBy(F.floor(place / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("bits"))
    held = np.zeros(WANTED_BITS // 64, np.int64)
    found = words.toArrow()
    held[found["w"].to_numpy()] = found["bits"].to_numpy()
    return np.unpackbits(held.view(np.uint8), bitorder="little").astype(bool)


def shingle_sets(docs: DataFrame, k: int, ids: DataFrame) -> DataFrame:
    """(doc_id, set): whole sets of shingles of all documents in `ids`, and of a few others whose hash is the same.

    The documents are told from the rest while they are read, so that no text is shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(wanted_filter(ids))

    def make(batches):
        for batch in batches:
            batch = batch.filter(pa.array(held.value[batch.column(2).to_numpy()]))
            rows, found = [], []
            for row, one in _sets(batch.column(1), k):
                rows.append(row)
                found.append(one.view(np.int64))
                if len(rows) >= 500:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), _list(found)], ["doc_id", "set"])
                    rows, found = [], []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), _list(found)], ["doc_id", "set"])

    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(WANTED_BITS))
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", place.alias("place")).mapInArrow(make, "doc_id long, set array<long>")


def _may_reach(percent: int) -> F.Column:
    """Sizes n and m of two sets whose shared shingle stands at places i and j allow the similarity."""
    least = F.ceil(F.lit(percent) * (F.col("a.n") + F.col("b.n")) / F.lit(100 + percent))
    smaller_first = F.when(F.col("a.n") <= F.col("b.n"), F.col("a.early")).otherwise(F.col("b.early"))
    return (
        (F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent)
        & (F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) >= least)
        & smaller_first
    )


def _bitmaps_allow(percent: int) -> F.Column:
    """Sets differ in at least as many shingles as their parity bitmaps differ in bits."""
    apart = sum(F.bit_count(F.col("a.bitmap")[i].bitwiseXOR(F.col("b.bitmap")[i])) for i in range(MAP_BITS // 64))
    return apart * (100 + percent) <= (F.col("a.n") + F.col("b.n")) * (100 - percent)


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Those of the pairs (a, b) of doc_ids whose whole sets are similar enough."""
    pairs = scratch.keep(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = scratch.keep(shingle_sets(docs, k, ids), "sets")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b")
    both = both.withColumn("i", F.size(F.array_intersect("x", "y")))
    good = scratch.keep(both.where(F.col("i") * 100 >= (F.size("x") + F.size("y") - F.col("i")) * percent).select("a", "b"), "good")
    scratch.drop(sets, pairs)
    return good


def _filtered(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs of two different documents, without those that bitmaps rule out or that links join already."""
    left = pairs.join(facts.select(F.col("doc_id").alias("pa"), F.struct("doc_id", "label", "n", "bitmap").alias("a")), "pa")
    right = facts.select(F.col("doc_id").alias("pb"), F.struct("doc_id", "label", "n", "bitmap").alias("b"))
    allowed = (F.col("a.label") != F.col("b.label")) & _bitmaps_allow(percent)
    return left.join(right, (left["pb"] == right["pb"]) & allowed).select("pa", right["pb"]).select(F.col("pa").alias("a"), F.col("pb").alias("b"))


#: Documents that go to Python at a time.
BATCH_ROWS = 1000


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 80, sketch_bits: int = 20, star_rounds: int = 2) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of documents whose shingle sets have a Jaccard similarity of
    `percent` / 100 or more.

    class_id is the smallest doc_id with the same set, component_id the smallest doc_id that links lead to.
    """
    with small_batches(docs.sparkSession, BATCH_ROWS):
        return _joined(docs, k, percent, sketch_bits, star_rounds)


def _joined(docs: DataFrame, k: int, percent: int, sketch_bits: int, star_rounds: int) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark)
    counts = shingle_counts(docs, k, sketch_bits)
    ranks = spark.sparkContext.broadcast(np.minimum(255, 8 * np.log2(np.maximum(counts, 1))).astype(np.uint8))
    made = scratch.keep(cards(docs, k, percent, ranks, sketch_bits), "cards")

    keys = ["n", "k1", "k2"]
    lows = made.where("n > 0").groupBy(keys).agg(F.min("doc_id").alias("cls"))
    members = scratch.keep(made.select("doc_id", "prefix_key", *keys).join(lows, keys, "left").select("doc_id", "n", "prefix_key", F.coalesce("cls", "doc_id").alias("cls")), "members")
    reps = members.where("n > 0 and doc_id = cls").select("doc_id", "n", "prefix_key").dropDuplicates(["doc_id"])
    group = reps.groupBy("n", "prefix_key").agg(F.min("doc_id").alias("gid"))
    reps = scratch.keep(reps.join(group, ["n", "prefix_key"]).select("doc_id", "gid", "n"), "reps")
    maps = scratch.keep(made.join(reps, ["doc_id", "n"], "left_semi").select("doc_id", "bitmap").dropDuplicates(["doc_id"]), "maps")

    # The smaller set of a pair shares a shingle in a shorter prefix still: the first n - ceil(2 t n / (1 + t)) + 1.
    early = F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / F.lit(100 + percent)) + 1
    heads = made.select("doc_id", "n", "prefix").join(reps.where("gid = doc_id"), ["doc_id", "n"], "left_semi")
    rows = heads.select(F.col("doc_id").alias("gid"), "n", F.posexplode("prefix").alias("at", "key"))
    rows = rows.select("key", "gid", (F.col("n") * F.lit(1 << 32) + F.col("at") * 2 + (F.col("at") < early).cast("int")).alias("packed"))
    shared = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    posts = rows.join(shared, "key").select("key", "gid", F.shiftright("packed", 32).alias("n"), F.shiftright(F.col("packed").bitwiseAND(F.lit((1 << 32) - 1)), 1).alias("at"), (F.col("packed").bitwiseAND(F.lit(1)) == 1).alias("early"))
    posts = scratch.keep(posts, "posts")
    scratch.drop(made)

    inner = reps.where("gid <> doc_id").select(F.col("gid").alias("pa"), F.col("doc_id").alias("pb"))
    label = scratch.keep(reps.select("doc_id", F.col("doc_id").alias("label")), "label")
    links = None
    apart = ~((F.col("a.lo") == F.col("a.hi")) & (F.col("a.lo") == F.col("b.lo")) & (F.col("b.lo") == F.col("b.hi")))
    for turn in range(star_rounds + 1):
        facts = scratch.keep(reps.join(label, "doc_id").join(maps, "doc_id"), "facts")
        span = facts.groupBy("gid").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        posted = posts.join(span, "gid")
        if turn < star_rounds:
            posted = posted.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent)))))
            order = F.col("gid") if turn == 0 else F.xxhash64("gid", F.lit(turn))
            hub = posted.groupBy("key", "band").agg(F.min(F.struct(order.alias("o"), "gid", "n", "at", "early", "lo", "hi")).alias("h"), F.count("*").alias("c")).where("c > 1")
            hub = hub.select("key", "band", "h.gid", "h.n", "h.at", "h.early", "h.lo", "h.hi")
            same = (F.col("a.key") == F.col("b.key")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.gid") != F.col("b.gid"))
            near = posted.alias("a").join(hub.alias("b"), same & apart & _may_reach(percent))
            pairs = near.select(F.least("a.gid", "b.gid").alias("pa"), F.greatest("a.gid", "b.gid").alias("pb")).distinct()
            pairs = pairs.union(inner) if turn == 0 else pairs
        else:
            same = (F.col("a.key") == F.col("b.key")) & (F.col("a.gid") < F.col("b.gid"))
            near = posted.alias("a").join(posted.alias("b"), same & apart & _may_reach(percent))
            groups = near.select(F.col("a.gid").alias("ga"), F.col("b.gid").alias("gb")).distinct()
            groups = groups.union(span.where("lo <> hi").select(F.col("gid").alias("ga"), F.col("gid").alias("gb")))
            side = reps.select("gid", "doc_id")
            left = groups.join(side.select(F.col("gid").alias("ga"), F.col("doc_id").alias("pa")), "ga")
            pairs = left.join(side.select(F.col("gid").alias("gb"), F.col("doc_id").alias("pb")), "gb").where("ga <> gb or pa < pb").select("pa", "pb")
        good = _verified(_filtered(pairs, facts, percent), docs, k, percent, scratch)
        links = good if links is None else links.union(good)
        if turn < star_rounds:
            # Links so far put labels together part of the way, which is enough to leave pairs out.
            step = links.select(F.col("b").alias("doc_id"), F.col("a").alias("to")).union(links.select("a", "b")).groupBy("doc_id").agg(F.min("to").alias("to"))
            step = scratch.keep(label.join(step, "doc_id", "left").select("doc_id", F.least("label", F.coalesce("to", "label")).alias("label")), "step")
            far = step.select(F.col("doc_id").alias("via"), F.col("label").alias("end"))
            label = scratch.keep(step.join(far, F.col("label") == F.col("via"), "left").select("doc_id", F.coalesce("end", "label").alias("label")), "label")
            scratch.drop(step, facts)
    joined = components(scratch, links)
    scratch.drop(posts, reps, maps)
    found = members.join(joined.select(F.col("id").alias("cls"), "component"), "cls", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"), F.coalesce("component", "cls").alias("component_id"))
