"""Toxicity scores by subword bags.

A word is the bag of its character 3- to 5-grams, between word marks, and of itself. Bags of windows of 4 words are
averaged and go through a linear softmax; embeddings and softmax are trained together in NumPy. A text's score is that of
its worst window, so that a few words count in a long text too. In training, a text stands for the window that the
model so far finds worst. Unseen misspellings share n-grams, and so vectors, with words that were learned.

The model is trained on a sample of the labelled documents with a text, `most_rows` with label 1 and twice as many with
label 0 at most (chosen by a hash of doc_id) and no more than 64 MiB of text of each label, in one task; documents above
1 MiB are not learned from. After training the softmax is folded into the embeddings: a text is scored by sums of one number per n-gram.

Null, empty and blank texts get the score of an empty bag. Without rows of both labels every text gets the share of
label 1 among the rows (0.5 without rows). Repeated labels of a document: toxic if one of them says so; null labels are
not learned from. Texts may have any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlemill.llm.words import LOWER, U, Words, mix, split_words

TABLE_BITS = 18
SIZES = (3, 4, 5)
WINDOW = 4
DIMENSIONS = 12
EPOCHS = 8
LEAST_STEPS = 1000
BATCH = 64
RATE = 0.05
#: Embeddings move faster than the softmax, as the average over a bag makes their gradients small.
GAIN = 100.0
#: Texts that an n-gram must be in, and deviations above its expected texts of label 1, to count at the start.
LEAST_TEXTS = 3
CHANCE = 3.0
SEED = 7
#: Bytes of text of a label, and of one document, that training takes.
MOST_BYTES = 1 << 26
MOST_TEXT_BYTES = 1 << 20
OPEN, CLOSE = 0x02, 0x03  # marks around a word; they are no characters of texts


def _grams(words: Words):
    """(word, bucket) of n-grams, one size at a time, words in order; the last one is of whole words."""
    sizes = words.ends - words.starts + 2
    ends = np.cumsum(sizes)
    begin = ends - sizes
    word = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(word)) - begin[word]
    wide = LOWER[words.data[np.minimum(np.maximum(words.starts[word] + place - 1, 0), len(words.data) - 1)]].astype(np.uint32)
    wide[begin], wide[ends - 1] = OPEN, CLOSE
    code = np.zeros(len(wide), np.uint32)
    for n in range(1, max(SIZES) + 1):
        rolled = wide[n - 1 :] if n > 1 else wide
        code[: len(rolled)] = code[: len(rolled)] * np.uint32(0x01000193) + rolled + np.uint32(1)
        if n in SIZES:
            fits = np.flatnonzero(place + n <= sizes[word])
            spread = (code[fits] + np.uint32(n)) * np.uint32(2654435761)
            spread ^= spread >> np.uint32(15)
            yield word[fits], ((spread * np.uint32(2246822519)) >> np.uint32(32 - TABLE_BITS)).astype(np.int64)
    yield np.arange(len(sizes)), (words.hashes >> U(64 - TABLE_BITS)).astype(np.int64)


def _windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The window of every word, and bounds of texts in windows; half-filled last windows join the one before."""
    sizes = np.diff(bounds)
    counts = np.where(sizes > 0, np.maximum(1, (sizes + WINDOW // 2) // WINDOW), 0)
    limits = np.concatenate(([0], np.cumsum(counts)))
    text = np.repeat(np.arange(len(sizes)), sizes)
    number = (np.arange(bounds[-1]) - bounds[text]) // WINDOW
    return limits[text] + np.minimum(number, counts[text] - 1), limits


def _bags(texts: pa.Array):
    """For pieces of texts: (first row, limits of texts in windows, [(window, bucket)])."""
    for words in split_words(texts):
        if len(words.starts):
            window, limits = _windows(words.bounds)
            yield words.first, limits, [(window[word], bucket) for word, bucket in _grams(words)]
        else:
            yield words.first, np.zeros(len(words.bounds), np.int64), []


def _sums(values: np.ndarray, parts, count: int) -> np.ndarray:
    total, size = np.zeros(count), np.zeros(count)
    for window, bucket in parts:
        total += np.bincount(window, weights=values[bucket], minlength=count)
        size += np.bincount(window, minlength=count)
    return total / np.maximum(size, 1)


def fit(texts: pa.Array, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, softmax weights and biases."""
    size = 1 << TABLE_BITS
    draw = np.random.default_rng(SEED)
    share = labels.mean() if len(labels) else 0.5
    weights, bias = np.zeros((DIMENSIONS, 2), np.float32), np.array([np.log(max(1 - share, 1e-6)), np.log(max(share, 1e-6))], np.float32)
    if share in (0, 1) or not len(labels):
        return np.zeros((size, DIMENSIONS), np.float32), weights, bias
    # Texts that have an n-gram, and those of label 1. N-grams in hardly any text say nothing, and are not learned.
    of_text, of_toxic, limits = np.zeros(size), np.zeros(size), [np.zeros(1, np.int64)]
    for first, bounds, parts in _bags(texts):
        text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        if parts:
            pairs = np.unique(np.concatenate([bucket * len(bounds) + text_of[window] for window, bucket in parts]))
            of_text += np.bincount(pairs // len(bounds), minlength=size)
            of_toxic += np.bincount(pairs // len(bounds), weights=labels[first + pairs % len(bounds)], minlength=size)
        limits.append(bounds[1:] + limits[-1][-1])
    limits = np.concatenate(limits)
    if not limits[-1]:
        return np.zeros((size, DIMENSIONS), np.float32), weights, bias
    common = of_text >= LEAST_TEXTS
    grams, sizes, known = [], [], []  # n-grams that are learned, all n-grams and learned ones of each window
    for _, bounds, parts in _bags(texts):
        if parts:
            sizes.append(sum(np.bincount(window, minlength=bounds[-1]) for window, _ in parts))
            window, bucket = (np.concatenate([p[i][common[p[1]]].astype(np.int32) for p in parts]) for i in (0, 1))
            known.append(np.bincount(window, minlength=bounds[-1]))
            grams.append(bucket[np.argsort(window, kind="stable")])
    grams, sizes, known = np.concatenate(grams), np.concatenate(sizes), np.concatenate(known)
    ends = np.cumsum(known)
    begins = ends - known
    has = np.flatnonzero(np.diff(limits) > 0)
    window_label = np.repeat(labels, np.diff(limits))

    def window_sums(values: np.ndarray) -> np.ndarray:
        found = np.zeros(len(sizes))
        for at in range(0, len(sizes), 1 << 16):  # a few million n-grams at a time
            first, end = begins[at : at + (1 << 16)], ends[at : at + (1 << 16)]
            total = np.concatenate(([0.0], np.cumsum(values[grams[first[0] : end[-1]]])))
            found[at : at + (1 << 16)] = total[end - first[0]] - total[first - first[0]]
        return found / sizes

    # Start from the windows with the n-grams that texts of label 1 have more often than chance explains.
    expected = of_text * share
    values = np.maximum((of_toxic - expected) / np.sqrt(expected + 1) - CHANCE, 0) ** 2
    embed = draw.uniform(-1, 1, (size, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    embed[~common] = 0
    weights = draw.normal(0, 1, weights.shape).astype(np.float32)
    steps = max(LEAST_STEPS, EPOCHS * len(has) // BATCH)
    step = 0
    while step < steps:
        score = window_sums(values)
        best = np.maximum.reduceat(score, limits[has])
        is_best = np.flatnonzero(score >= np.repeat(best, np.diff(limits)[has]))
        top = is_best[np.unique(np.searchsorted(limits, is_best, "right"), return_index=True)[1]]
        # Of texts with label 0 a random window as well, all of which must score low.
        others = limits[has] + (draw.random(len(has)) * np.diff(limits)[has]).astype(np.int64)
        chosen = np.concatenate((top, others[labels[has] == 0]))
        draw.shuffle(chosen)
        for at in range(0, len(chosen), BATCH):
            batch = chosen[at : at + BATCH]
            lengths = known[batch]
            owner = np.repeat(np.arange(len(batch)), lengths)
            index = grams[np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(begins[batch], lengths)]
            mean = np.zeros((len(batch), DIMENSIONS), np.float32)
            np.add.at(mean, owner, embed[index])
            mean /= sizes[batch][:, None]
            odds = mean @ weights + bias
            odds = np.exp(odds - odds.max(1, keepdims=True))
            miss = odds / odds.sum(1, keepdims=True)
            miss[np.arange(len(batch)), window_label[batch]] -= 1
            rate = RATE * max(0.05, 1 - step / steps)
            to_rows = (miss @ weights.T / sizes[batch][:, None] * rate * GAIN).astype(np.float32)
            weights -= rate * (mean.T @ miss)
            bias -= rate * 0.1 * miss.sum(0)
            np.subtract.at(embed, index, to_rows[owner])
            step += 1
        values = fold(embed, weights)
    return embed, weights, bias


def fold(embed: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What an n-gram adds to the log odds of label 1, before averaging."""
    return (embed @ (weights[:, 1] - weights[:, 0])).astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 1500) -> tuple[np.ndarray, float]:
    """Folded n-gram values and the bias. `labels` has doc_id and toxic; of the documents with a label and a text at most
    `most_rows` with label 1 and twice as many with label 0 are used, in the order of a hash, and of each label no more
    than MOST_BYTES of text. All texts of a doc_id count together; with more than MOST_TEXT_BYTES it is not used."""
    clean = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(SEED))
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    sizes = texts.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    usable = sizes.where(F.col("bytes") <= MOST_TEXT_BYTES).join(clean, "doc_id")
    first = usable.where("toxic = 1").orderBy(order).limit(most_rows).union(usable.where("toxic = 0").orderBy(order).limit(most_rows * 2))
    # At most three times most_rows rows without their texts.
    so_far = Window.partitionBy("toxic").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = first.withColumns({"rows": F.sum("n").over(so_far), "all_bytes": F.sum("bytes").over(so_far)})
    chosen = summed.where((F.col("all_bytes") <= MOST_BYTES) & (F.col("rows") <= F.when(F.col("toxic") == 1, most_rows).otherwise(most_rows * 2))).select("doc_id", "toxic")
    rows = texts.join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("long").alias("toxic"), order.alias("place"))

    def learn(batches):
        table = pa.Table.from_batches(list(batches))
        table = table.sort_by("place") if table.num_rows else table
        if table.num_rows:
            texts, wanted = table.column(0).combine_chunks(), table.column(1).to_numpy()
            embed, weights, bias = fit(texts, wanted.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([fold(embed, weights).tobytes()], pa.binary()), pa.array([float(bias[1] - bias[0])])], ["grams", "bias"])

    model = rows.repartition(1).mapInArrow(learn, "grams binary, bias double").collect()
    if not model:
        return np.zeros(1 << TABLE_BITS), 0.0
    return np.frombuffer(model[0].grams, np.float64), model[0].bias


def score_texts(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score, first, end): the score and the words of the window it comes from (0, 0 without words)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        values, bias = held.value
        for batch in batches:
            for start, limits, parts in _bags(batch.column(1)):
                n = len(limits) - 1
                logits = _sums(values, parts, int(limits[-1]))
                full = np.flatnonzero(np.diff(limits) > 0)
                best, place = np.full(n, 0.0), np.zeros(n, np.int64)
                if len(full):
                    best[full] = np.maximum.reduceat(logits, limits[full])
                    hit = np.flatnonzero(logits >= np.repeat(best[full], np.diff(limits)[full]))
                    text, index = np.unique(np.searchsorted(limits, hit, "right") - 1, return_index=True)
                    place[text] = hit[index] - limits[text]
                found = 1 / (1 + np.exp(-(best + bias)))
                columns = [batch.column(0).slice(start, n), pa.array(found), pa.array(place * WINDOW), pa.array(np.where(np.diff(limits) > 0, place * WINDOW + WINDOW, 0))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "first", "end"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double, first long, end long")
