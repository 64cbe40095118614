"""Benchmark decontamination: passages of documents that nearly repeat a benchmark item.

Words are runs of characters between white space and ASCII punctuation, A-Z lower-cased; shingles are runs of five of
them, and a text's shingles weigh as often as they occur. A window of a document that has as many words as an item is
compared with it in two steps. The 64-bit SimHash of the window, from running sums of its shingles' bits, is looked up
in a multi-index of the items' fingerprints: fingerprints at most `radius` bits apart differ by a quarter of that at
most in one of their four blocks, and the index of a block lists the items near each of its values, so that no item
within the radius is missed. The exact weighted Jaccard similarity of the shingles then decides.

Windows without any shingle of an item of their size have similarity 0 and are not fingerprinted. Fingerprints of
texts of similarity 0.8 differ by about 10 bits, by more than the default radius in about one of a thousand cases.

Items are a stated query set: they go to the tasks in blocks of bounded size, and no document is shuffled. Null and
empty texts and items match nothing, items of fewer than five words are compared as one shingle, repeated rows and items
are compared one by one. Texts may have any length.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.llm.words import GAPS, U, runs, split_words

#: Items that are sent to the tasks together. A block's tables take about 20 MB.
BLOCK_ITEMS = 500
BLOCKS, BLOCK_BITS = 4, 16


def _bits(hashes: np.ndarray) -> np.ndarray:
    """A row of 64 votes of -1 or 1 per shingle."""
    return np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).astype(np.int8) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(U).ravel()


class Items:
    """Items of a block, and the indexes to look windows up in."""

    def __init__(self, ids: list, texts: list[str | None], k: int, radius: int) -> None:
        self.ids, self.shingles, self.sizes = [], [], []
        row = 0
        for words in split_words(pa.array(texts, pa.string()), GAPS):
            for i in range(len(words.bounds) - 1):
                hashes = words.hashes[words.bounds[i] : words.bounds[i + 1]]
                if len(hashes):
                    self.ids.append(ids[row])
                    self.sizes.append(len(hashes))
                    self.shingles.append(np.sort(runs(hashes, min(k, len(hashes)))))
                row += 1
        self.k, self.radius = k, radius
        prints = [_fingerprints(_bits(x).astype(np.int32).sum(0, keepdims=True))[0] for x in self.shingles]
        self.prints = np.array(prints, U)
        sizes = np.array(self.sizes, np.int64)
        self.lengths = np.minimum(k, sizes)
        # Every shingle, and the sizes of items that have it.
        pairs = sorted({(int(s), n) for x, n in zip(self.shingles, self.sizes, strict=True) for s in x.tolist()})
        self.known = np.array([s for s, _ in pairs], U)
        self.known_size = np.array([n for _, n in pairs], np.int64)
        # Items near each value of a block of bits.
        reach = radius // BLOCKS
        flips = np.array([sum(1 << b for b in c) for n in range(reach + 1) for c in combinations(range(BLOCK_BITS), n)], np.int64)
        self.starts, self.near = [], []
        for b in range(BLOCKS):
            values = self._block(self.prints, b)[:, None] ^ flips[None, :]
            item = np.repeat(np.arange(len(self.prints)), len(flips))
            order = np.argsort(values.ravel(), kind="stable")
            self.starts.append(np.searchsorted(values.ravel()[order], np.arange((1 << BLOCK_BITS) + 1)))
            self.near.append(item[order].astype(np.int32))

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> U(b * BLOCK_BITS)) & U((1 << BLOCK_BITS) - 1)).astype(np.int64)

    def look_up(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all fingerprints within the radius."""
        found = []
        for b in range(BLOCKS):
            value = self._block(prints, b)
            low, high = self.starts[b][value], self.starts[b][value + 1]
            count = high - low
            window = np.repeat(np.arange(len(prints)), count)
            item = self.near[b][np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
            close = np.bitwise_count(prints[window] ^ self.prints[item]) <= self.radius
            found.append(window[close] * len(self.prints) + item[close])
        both = np.unique(np.concatenate(found))
        return both // max(1, len(self.prints)), both % max(1, len(self.prints))


def _similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted lists of shingles."""
    values, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    one = np.bincount(inverse[: len(a)], minlength=len(values))
    two = np.bincount(inverse[len(a) :], minlength=len(values))
    return float(np.minimum(one, two).sum() / np.maximum(one, two).sum())


def _matches(hashes: np.ndarray, every: dict[int, np.ndarray], items: Items, percent: int) -> list[tuple[int, int, int, float]]:
    """(item, first word, words, similarity) of a document's windows, the best of those that overlap."""
    found = []
    hit_sizes: dict[int, list[np.ndarray]] = {}
    for shingle in every.values():
        at = np.searchsorted(items.known, shingle)
        hit = np.flatnonzero((at < len(items.known)) & (items.known[np.minimum(at, len(items.known) - 1)] == shingle))
        for p in hit.tolist():
            j = int(at[p])
            while j < len(items.known) and items.known[j] == shingle[p]:
                hit_sizes.setdefault(int(items.known_size[j]), []).append(p)
                j += 1
    for size, places in hit_sizes.items():
        k = min(items.k, size)
        shingle, n = every[k], size - k + 1
        if len(shingle) < n:
            continue
        # Starts of windows that hold one of the places.
        mark = np.zeros(len(shingle) + 1, np.int64)
        place = np.array(places)
        np.add.at(mark, np.maximum(0, place - n + 1), 1)
        np.add.at(mark, place + 1, -1)
        starts = np.flatnonzero(np.cumsum(mark)[: len(shingle) - n + 1] > 0)
        if not len(starts):
            continue
        low = int(starts[0])
        sums = np.zeros((int(starts[-1]) + n - low + 1, 64), np.int32)
        np.cumsum(_bits(shingle[low : int(starts[-1]) + n]), axis=0, out=sums[1:])
        prints = _fingerprints(sums[starts - low + n] - sums[starts - low])
        window, item = items.look_up(prints)
        for w, i in zip(window.tolist(), item.tolist(), strict=True):
            if items.sizes[i] == size:
                start = int(starts[w])
                same = _similarity(np.sort(shingle[start : start + n]), items.shingles[i])
                if same * 100 >= percent - 1e-9:
                    found.append((i, start, size, same))
    best: list[tuple[int, int, int, float]] = []
    for i, start, size, same in sorted(found, key=lambda x: (x[0], -x[3], x[1])):
        if all(j != i or start >= s + size or s >= start + size for j, s, _, _ in best):
            best.append((i, start, size, same))
    return best


def contaminated(docs: DataFrame, items: DataFrame, percent: int = 80, k: int = 5, radius: int = 19) -> DataFrame:
    """(doc_id, item_id, first, n_words, similarity): passages that are similar to an item, overlaps left out."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, first long, n_words long, similarity double"
    count = items.where("text is not null").count()
    blocks = max(1, -(-count // BLOCK_ITEMS))
    # Hash ranges come out uneven by a little, so they are made smaller than a block by a fifth.
    blocks = blocks if blocks == 1 else -(-count * 5 // (BLOCK_ITEMS * 4))
    parts = []
    for b in range(blocks):
        rows = items.where("text is not null").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).select("item_id", "text").collect()
        held = spark.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows]))
        parts.append(docs.select("doc_id", "text").mapInArrow(_search(held, percent, k, radius), schema))
    return reduce(DataFrame.union, parts)


def _search(held, percent: int, k: int, radius: int):
    def search(batches):
        items = Items(*held.value, k, radius)
        lengths = sorted(set(items.lengths.tolist()))
        # Most shingles of documents are in no item: a bit per hash tells that fast.
        seen = np.zeros(1 << 20, bool)
        seen[(items.known >> U(44)).astype(np.int64)] = True
        for batch in batches:
            rows, found = [], []
            for words in split_words(batch.column(1), GAPS):
                n = len(words.hashes)
                every = {x: runs(words.hashes, x) for x in lengths}
                hits = [np.flatnonzero(seen[(s >> U(44)).astype(np.int64)]) for s in every.values()]
                texts = np.unique(np.concatenate([np.searchsorted(words.bounds, h, "right") - 1 for h in hits])) if hits and n else []
                for t in texts:
                    a, b = int(words.bounds[t]), int(words.bounds[t + 1])
                    own = {x: s[a : max(a, b - x + 1)] for x, s in every.items()}
                    for match in _matches(words.hashes[a:b], own, items, percent):
                        rows.append(words.first + int(t))
                        found.append(match)
            if rows:
                ids = [items.ids[m[0]] for m in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(ids, item_type(ids)), pa.array([m[1] for m in found]), pa.array([m[2] for m in found]), pa.array([m[3] for m in found])],
                    ["doc_id", "item_id", "first", "n_words", "similarity"],
                )

    def item_type(ids: list):
        return pa.array(ids).type

    return search
