"""Alignment of two tokenizers over the bytes of whole texts.

Tokenizer A (byte-level BPE) encodes a space and the text, B (BPE over pieces, which adds that space itself) the text.
All tokens of a batch, of A and B together, are sorted by the byte they start at; a running maximum of their ends shows
where groups break: at a start that reaches the maximum of the ends before it. There both tokenizers have a token end.
Within a group every token of A is linked with every token of B.

A unit (`units.py`) ends where both end a token, so the groups of a text are those of its units, one after the other. A
task aligns each different unit once and adds units up to documents.

How many documents hold an id pair linked is counted over the corpus: by tasks first, then by pair. The pairs with the
highest counts, at most HOT_PAIRS whatever the corpus, go to all tasks; a document's other pairs are joined with the
counts by pair. The threshold between them comes from a histogram of the counts and decides about cost alone.

Texts that are null or empty, or whose tokens' bytes, joined, differ from the space and the text (pieces stand for the
character U+2581 as well as for a space), have no tokens: zeros. Special tokens' strings are ordinary text. Rows that
repeat a doc_id, or have none, are documents of their own. Ties: every pair with the highest count of its A id is best.
Columns other than doc_id and text are not read. A unit of any length is aligned as a whole; links of large groups are
expanded by different ids, not by occurrences.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlemill.llm.scratch import Scratch, small_batches
from candlemill.llm.units import MOST_UNITS, Store, Units, encode_units, in_segments, load_tokenizer, pieces_keep_spaces_first, pieces_of, ranges, splits_before_spaces

#: Pairs whose counts are sent to all tasks: 17 bytes each, 4.5 MB at most.
HOT_PAIRS = 1 << 18
#: Counts fall into this many classes for each power of two.
CLASSES = 16
BATCH_ROWS = 1000
#: Links expanded at a time, and links from which a group is expanded by different ids.
LINKS_AT_ONCE = 1 << 21
LARGE_GROUP = 1 << 12


def byte_letters() -> dict[str, int]:
    """Letters of byte-level vocabularies: printable bytes stand for themselves, the others for 256, 257 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def piece_bytes(piece: str) -> bytes:
    m = re.fullmatch("<0x([0-9A-F]{2})>", piece)
    return bytes([int(m[1], 16)]) if m else piece.replace("▁", " ").encode()


class Pair:
    """The two tokenizers, with the bytes of every token."""

    def __init__(self, path_a: str, path_b: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.a = load_tokenizer(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        names_a = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.bytes_a = [n.encode() if n in special else bytes(letters[c] for c in n) for n in names_a]
        names_b = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [piece_bytes(p) for p in names_b]
        self.size_b = len(names_b)
        self.leads = np.array([t.startswith(b" ") for t in self.bytes_a])
        self.cut = splits_before_spaces(self.a) and pieces_keep_spaces_first(names_b)
        self.len_a, self.len_b = (np.array([len(t) for t in names], np.int64) for names in (self.bytes_a, self.bytes_b))
        # What a token adds to a digest, followed by another token of its side or by the end of it.
        self.text_a, self.text_b = (tuple(np.array([f"{i}{end}" for i in range(len(t))], object) for end in ends) for t, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;")))

    def encode(self, units: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids by A of all units, each with a space before it, and how many each has; the same by B; which units count.

        Those whose tokens do not give back their bytes have no tokens and do not count.
        """
        ids_a, n_a = encode_units(self.a, units, self.leads, plain)
        found = self.b.encode(units, num_threads=1)
        ids_b, n_b = np.array(list(chain.from_iterable(found)), np.int64), np.array([len(f) for f in found], np.int64)
        texts = [b" " + u.encode() for u in units]
        whole = b"".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        if self._give_back(whole, sizes, self.bytes_a, self.len_a, ids_a, n_a) and self._give_back(whole, sizes, self.bytes_b, self.len_b, ids_b, n_b):
            return ids_a, n_a, ids_b, n_b, np.ones(len(units), bool)
        good = np.array([self._same(t, self.bytes_a, x) and self._same(t, self.bytes_b, y) for t, x, y in zip(texts, self._cut(ids_a, n_a), found, strict=True)], bool)
        return ids_a[np.repeat(good, n_a)], n_a * good, ids_b[np.repeat(good, n_b)], n_b * good, good

    @staticmethod
    def _give_back(whole: bytes, sizes: np.ndarray, names: list[bytes], lengths: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> bool:
        ends = np.r_[0, np.cumsum(lengths[ids])][np.cumsum(counts)] if len(counts) else sizes
        return bool((ends == np.cumsum(sizes)).all()) and b"".join(map(names.__getitem__, ids.tolist())) == whole

    @staticmethod
    def _cut(ids: np.ndarray, counts: np.ndarray) -> list[list[int]]:
        ends = np.r_[0, np.cumsum(counts)].tolist()
        every = ids.tolist()
        return [every[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    @staticmethod
    def _same(text: bytes, names: list[bytes], ids: list[int]) -> bool:
        return b"".join(map(names.__getitem__, ids)) == text


def coalesce(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of every interval of A and of B, and the number of groups; groups are numbered by their starts."""
    start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    order = np.lexsort((np.arange(len(start)) >= len(start_a), start))
    reached = np.maximum.accumulate(end[order]) if len(order) else end
    opens = np.ones(len(order), bool)
    opens[1:] = start[order][1:] >= reached[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(opens) - 1
    return group[: len(start_a)], group[len(start_a) :], int(opens.sum())


def add_up(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, rising, and the sum of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values[order], first) if len(first) else values[:0]


def linked_pairs(group_a: np.ndarray, ids_a: np.ndarray, group_b: np.ndarray, ids_b: np.ndarray, groups: int, owner: np.ndarray, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, pair, links): how often each owner of groups links each id pair, a * size_b + b, by owner and pair."""
    n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    weight_a, weight_b = np.ones(len(ids_a), np.int64), np.ones(len(ids_b), np.int64)
    if (large := n_a * n_b >= LARGE_GROUP).any():
        group_a, ids_a, weight_a = _by_different_ids(group_a, ids_a, large)
        group_b, ids_b, weight_b = _by_different_ids(group_b, ids_b, large)
        n_b = np.bincount(group_b, minlength=groups)
    first_b = np.cumsum(n_b) - n_b
    sizes = n_b[group_a]
    done = np.cumsum(sizes)
    parts, at = [], 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + LINKS_AT_ONCE, "right")))
        k = sizes[at:to]
        b = ranges(first_b[group_a[at:to]], k)
        pair = np.repeat(ids_a[at:to], k) * size_b + ids_b[b]
        who = np.repeat(owner[group_a[at:to]], k)
        weight = np.repeat(weight_a[at:to], k) * weight_b[b]
        parts.append(_by_owner(who, pair, weight))
        at = to
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    return _by_owner(*(np.concatenate(c) for c in zip(*parts, strict=True))) if len(parts) > 1 else parts[0]


def _by_different_ids(group: np.ndarray, ids: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In large groups each different id once, with its occurrences; in the others every token as it is."""
    order = np.lexsort((np.where(large[group], ids, np.arange(len(ids))), group))
    group, ids = group[order], ids[order]
    first = np.r_[True, (group[1:] != group[:-1]) | (ids[1:] != ids[:-1]) | ~large[group[1:]]]
    at = np.flatnonzero(first)
    return group[at], ids[at], np.diff(np.r_[at, len(ids)])


def _by_owner(who: np.ndarray, pair: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(who):
        return who, pair, weight
    span = int(pair.max(initial=0)) + 1
    if (int(who.max(initial=0)) + 1) * span < 2**63:
        keys, weight = add_up(who * span + pair, weight)
        return keys // span, keys % span, weight
    order = np.lexsort((pair, who))
    who, pair, weight = who[order], pair[order], weight[order]
    first = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (pair[1:] != pair[:-1])])
    return who[first], pair[first], np.add.reduceat(weight, first)


class Aligner:
    """Aligned units of a task, by number."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.pair, self.most = Pair(path_a, path_b), MOST_UNITS // 2
        self._start()

    def _start(self) -> None:
        self.units, self.pairs = Units(self._align, self.pair.cut), Store(2)
        self.facts = [np.zeros((0, 5), np.int64)]  # tokens of A and B, groups, links, 1 if the bytes differ
        self.digests = [pa.array([], pa.string())]

    def _align(self, units: list[str], plain: bool) -> list[int]:
        if not units:
            return []
        pair = self.pair
        ids_a, n_a, ids_b, n_b, good = pair.encode(units, plain)
        # Tokens follow each other without gaps, so ends are running sums, over all units alike.
        end_a, end_b = np.cumsum(pair.len_a[ids_a]), np.cumsum(pair.len_b[ids_b])
        group_a, group_b, groups = coalesce(end_a - pair.len_a[ids_a], end_a, end_b - pair.len_b[ids_b], end_b)
        owner = np.empty(groups, np.int64)
        owner[group_a] = np.repeat(np.arange(len(units)), n_a)
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        facts = np.zeros((len(units), 5), np.int64)
        facts[:, 0], facts[:, 1], facts[:, 4] = n_a, n_b, ~good
        facts[:, 2] = np.bincount(owner, minlength=len(units))
        np.add.at(facts[:, 3], owner, in_a * in_b)
        who, keys, links = linked_pairs(group_a, ids_a, group_b, ids_b, groups, owner, pair.size_b)
        # Tokens in the order of a digest: by group, those of A first.
        digest = np.empty(len(ids_a) + len(ids_b), object)
        last_a, last_b = (np.r_[g[1:] != g[:-1], True][: len(g)] for g in (group_a, group_b))
        before_a, before_b = np.cumsum(in_a), np.cumsum(in_b) - in_b
        digest[np.arange(len(ids_a)) + before_b[group_a]] = np.where(last_a, pair.text_a[1][ids_a], pair.text_a[0][ids_a])
        digest[np.arange(len(ids_b)) + before_a[group_b]] = np.where(last_b, pair.text_b[1][ids_b], pair.text_b[0][ids_b])
        ends = np.r_[0, np.cumsum(n_a + n_b)]
        digest = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(digest.tolist(), pa.string()))
        self.digests.append(pc.binary_join(digest, ""))
        self.facts.append(facts)
        return self.pairs.add(np.bincount(who, minlength=len(units)), keys, links)

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Facts and digest of each text; bounds of texts among id pairs, the pairs and how often each is linked.

        `texts` are large strings without nulls.
        """
        if self.pairs.rows > self.most:
            self._start()
        size = pc.binary_length(texts).to_numpy()
        has = np.flatnonzero(size)
        parts, owner = in_segments(texts.take(pa.array(has))) if self.pair.cut else (texts.take(pa.array(has)), np.arange(len(has)))
        owner = has[owner]
        unit, bounds, _ = self.units.of(parts)
        self.facts, self.digests = [np.concatenate(self.facts)], [pa.concat_arrays(self.digests)]
        doc = np.repeat(owner, np.diff(bounds))
        total = np.zeros((len(texts), 5), np.int64)
        for c in range(5):
            total[:, c] = np.bincount(doc, self.facts[0][unit, c], len(texts))
        none = total[:, 4] > 0
        total[none] = 0
        hashes = [hashlib.sha256() if s and not n else None for s, n in zip(size.tolist(), none.tolist(), strict=True)]
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), self.digests[0].take(pa.array(unit))), "")
        own = owner.tolist()
        for j, i in enumerate(own):
            if hashes[i]:
                last = own[j + 1 : j + 2] != [i]
                piece = memoryview(joined[j].as_buffer())
                hashes[i].update(piece[: len(piece) - last])  # without the mark behind the last group
        some = ~none[doc]
        codes, times = np.unique(doc[some] * max(1, self.pairs.rows) + unit[some], return_counts=True)
        doc, unit = codes // max(1, self.pairs.rows), codes % max(1, self.pairs.rows)
        sizes, keys, links = self.pairs.take(unit)
        doc, keys, links = _by_owner(np.repeat(doc, sizes), keys, links * np.repeat(times, sizes))
        return total[:, :4], [h.hexdigest() if h else "" for h in hashes], np.searchsorted(doc, np.arange(len(texts) + 1)), keys, links


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, links binary"


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Tokens and groups of every document, and its id pairs with the number of links of each, as little-endian longs."""

    def run(batches):
        aligner = Aligner(path_a, path_b)
        for batch in batches:
            for first, texts in pieces_of(batch.column(2)):
                facts, digests, bounds, keys, links = aligner.documents(texts)
                own = batch.slice(first, len(texts))
                cut = [[x[s:e].astype("<i8").tobytes() for s, e in zip(bounds, bounds[1:], strict=False)] for x in (keys, links)]
                columns = [own.column(0), own.column(1), *(pa.array(facts[:, c]) for c in range(4)), pa.array(digests), *(pa.array(c, pa.binary()) for c in cut)]
                yield pa.RecordBatch.from_arrays(columns, _names(ALIGNED))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, ALIGNED)


def _longs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The longs of all rows, one row after the other, and how many each row has."""
    sizes = np.array([len(v.as_buffer()) // 8 for v in column], np.int64)
    return np.frombuffer(b"".join(column.to_pylist()), "<i8"), sizes


def count_pairs(aligned: DataFrame) -> DataFrame:
    """(pair, n): the documents that link an id pair. Tasks count first and send each pair once for up to 2^20 of them."""

    def count(batches):
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            more = _longs(batch.column(0))[0]
            keys, n = add_up(np.concatenate([keys, more]), np.concatenate([n, np.ones(len(more), np.int64)]))
            if len(keys) >= 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])
                keys, n = keys[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])

    return aligned.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _class(n: str) -> Column:
    return F.floor(F.log2(n) * CLASSES).cast("int")


def align_tokens(docs: DataFrame, path_a: str, path_b: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row per row of `docs`."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    size_b = Pair(path_a, path_b).size_b
    with small_batches(spark, BATCH_ROWS):
        aligned = scratch.keep(align(docs, path_a, path_b), "aligned")
        counted = scratch.keep(count_pairs(aligned).withColumn("a", F.expr(f"pair div {size_b}")), "pair_counts")
    best = counted.groupBy("a").agg(F.max("n").alias("most"))  # no more rows than A has ids
    counts = scratch.keep(counted.join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair_counts")
    room, least = hot_pairs, None
    for row in counts.groupBy(_class("n").alias("class")).count().orderBy(F.desc("class")).collect():
        room -= row["count"]
        if room < 0:
            break
        least = row["class"]
    is_hot = F.lit(False) if least is None else _class("n") >= least
    hot = counts.where(is_hot).toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast(tuple(hot.column(c).to_numpy() for c in ("pair", "n", "best")))

    def look_up(batches):
        hot, counts_of, best_of = shared.value
        for batch in batches:
            (keys, sizes), (links, _) = _longs(batch.column(7)), _longs(batch.column(8))
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(hot, keys), max(len(hot) - 1, 0))
            known = hot[at] == keys if len(hot) else np.zeros(len(keys), bool)
            sums, bests = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(sums, row[known], links[known] * counts_of[at[known]])
            np.add.at(bests, row[known], links[known] * best_of[at[known]])
            ends = np.r_[0, np.cumsum(np.bincount(row[~known], minlength=len(sizes)))].astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[~known])) for x in (keys, links)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(bests), pa.array(sums), *rest], names)

    schema = ALIGNED.replace("pairs binary, links binary", "n_best long, count_sum long, pairs array<long>, links array<long>")
    names = _names(schema)
    with small_batches(spark, BATCH_ROWS):
        looked_up = scratch.keep(aligned.mapInArrow(look_up, schema), "looked_up")
    scratch.drop(aligned)
    rest = looked_up.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.links").alias("links"))
    cold = rest.join(counts.where(~is_hot), "pair").groupBy("row")
    cold = cold.agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_sum"))
    joined = looked_up.drop("pairs", "links").join(cold, "row", "left")
    n_best, count_sum = (F.col(x) + F.coalesce(y, F.lit(0)) for x, y in (("n_best", "more_best"), ("count_sum", "more_sum")))
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", n_best.alias("n_best"), count_sum.alias("count_sum"), "groups_sha256")
