"""Language identification of whole, possibly mixed texts.

Every word gets a score per language from its byte trigrams. Script ranges narrow the candidates first: a word with
letters of a script a language was hardly ever seen with is not scored for it. A Viterbi pass with a switching penalty
then labels the words, so that a text falls into spans of one language; the language with most letters is predicted.

Long texts are cut into chunks for the Viterbi pass. A chunk is solved for every label that might stand before it, and
the solutions are put together by the same recursion, so that the labels are those of the whole text.

Null texts and texts without a letter are `und` with score 0 and no spans. Without any training row all are `und`.
Repeated rows are predicted one by one. Texts may have any length.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.llm.words import LOWER, Words, split_words

TABLE_BITS = 17
CHUNK_WORDS = 256

# The first and last code point of ranges of letters, and their script.
SCRIPTS = ["latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "devanagari", "bengali", "thai", "georgian", "hangul", "kana", "han"]
RANGES = [
    (0x00C0, 0x024F, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0531, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"), (0x0600, 0x06FF, "arabic"), (0x0750, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"),
    (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"), (0x3040, 0x30FF, "kana"), (0x3400, 0x4DBF, "han"),
    (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"),
]
#: Least share of a language's letters in a script for its words to be scored in it.
SCRIPT_SHARE = 1e-4

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
#: Lower-cased letters; all else counts as a gap between letters.
NORMAL = np.where(LETTER, LOWER, 0x20).astype(np.uint8)


class Model(NamedTuple):
    langs: list[str]
    scores: np.ndarray  # per bucket of trigrams and language: log probability
    scripts: np.ndarray  # per language: scripts it is written in, as bits


def _trigrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Positions of letters, and the bucket of the trigram around each."""
    normal = NORMAL[words.data]
    at = np.flatnonzero(LETTER[words.data])
    wide = np.full(len(normal) + 2, 0x20, np.uint32)
    wide[1:-1] = normal
    code = (wide[at] << np.uint32(16)) | (wide[at + 1] << np.uint32(8)) | wide[at + 2]
    return at, (code * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)


def _scripts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of characters with a known script, and the script."""
    plain = np.flatnonzero(LETTER[data] & (data < 128))
    lead = np.flatnonzero(data >= 0xC2)
    wide = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int64)
    b0, b1, b2 = wide[lead], wide[lead + 1] & 63, wide[lead + 2] & 63
    point = np.where(b0 < 0xE0, (b0 & 31) << 6 | b1, np.where(b0 < 0xF0, (b0 & 15) << 12 | b1 << 6 | b2, 1 << 20))
    firsts, lasts = np.array([r[0] for r in RANGES]), np.array([r[1] for r in RANGES])
    kinds = np.array([SCRIPTS.index(r[2]) for r in RANGES])
    slot = np.searchsorted(firsts, point, "right") - 1
    known = (slot >= 0) & (point <= lasts[slot])
    return np.concatenate((plain, lead[known])), np.concatenate((np.zeros(len(plain), np.int64), kinds[slot[known]]))


def train(docs: DataFrame) -> Model:
    """Trigram and script counts per language over all rows of (text, lang), added up by Spark.

    The model has a table of fixed size per language, whatever the corpus; languages are few.
    """

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1)
            names = langs.unique().to_pylist()
            index = np.array(pa.compute.index_in(langs, pa.array(names)).to_numpy(zero_copy_only=False), np.int64)
            for words in split_words(batch.column(0)):
                sizes = np.diff(words.bounds)
                text_of = np.repeat(index[words.first : words.first + len(sizes)], sizes)
                at, bucket = _trigrams(words)
                lang_at = text_of[np.searchsorted(words.starts, at, "right") - 1]
                where, script = _scripts(words.data)
                lang_script = text_of[np.searchsorted(words.starts, where, "right") - 1]
                for i, name in enumerate(names):
                    if i not in lang_at:
                        continue
                    total = totals.setdefault(name, np.zeros((1 << TABLE_BITS) + len(SCRIPTS), np.int64))
                    total[: 1 << TABLE_BITS] += np.bincount(bucket[lang_at == i].astype(np.int64), minlength=1 << TABLE_BITS)
                    total[1 << TABLE_BITS :] += np.bincount(script[lang_script == i], minlength=len(SCRIPTS))
        for name, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total.tobytes()], pa.binary())], ["lang", "counts"])

    def add(key, table):
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("counts"))
        return pa.table({"lang": [key[0].as_py()], "counts": pa.array([total.tobytes()], pa.binary())})

    parts = docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(count, "lang string, counts binary")
    rows = sorted(parts.groupBy("lang").applyInArrow(add, "lang string, counts binary").collect())
    if not rows:
        return Model([], np.zeros((1 << TABLE_BITS, 0), np.float32), np.zeros(0, np.int64))
    counts = np.stack([np.frombuffer(r.counts, np.int64) for r in rows])
    grams, scripts = counts[:, : 1 << TABLE_BITS] + 0.5, counts[:, 1 << TABLE_BITS :]
    scores = np.log(grams / grams.sum(1, keepdims=True)).T.astype(np.float32)
    seen = scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(1, keepdims=True))
    return Model([r.lang for r in rows], np.ascontiguousarray(scores), (seen << np.arange(len(SCRIPTS))).sum(1))


def word_scores(words: Words, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Scores of words by language, at most 0, and letters of words."""
    n, langs = len(words.starts), len(model.langs)
    letters, scores, found = np.zeros(n, np.int64), np.zeros((n, langs), np.float32), np.zeros(n, np.int64)
    at, bucket = _trigrams(words)
    if len(at):
        word = np.searchsorted(words.starts, at, "right") - 1
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        scores[word[first]] = np.add.reduceat(model.scores[bucket], first, axis=0)
        letters[word[first]] = np.add.reduceat(((words.data[at] & 0xC0) != 0x80).astype(np.int64), first)
    where, script = _scripts(words.data)
    np.bitwise_or.at(found, np.searchsorted(words.starts, where, "right") - 1, np.int64(1) << script)
    barred = (found[:, None] & ~model.scripts[None, :]) != 0
    barred &= ~barred.all(1, keepdims=True)
    scores -= scores.max(1, keepdims=True) if langs else 0
    scores[barred] -= 100
    return scores, letters


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word, for texts with words bounds[i] to bounds[i + 1]."""
    n, langs = scores.shape
    sizes = np.diff(bounds)
    counts = -(-sizes // CHUNK_WORDS)
    total = int(counts.sum())
    if not total or langs < 2:
        return np.zeros(n, np.int64)
    text = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    start = bounds[text] + number * CHUNK_WORDS
    length = np.minimum(CHUNK_WORDS, bounds[text + 1] - start)
    padded = np.concatenate((scores, np.zeros((1, langs), np.float32)))

    def at(t: int) -> np.ndarray:
        return padded[np.where(t < length, start + t, n)]

    # Axis 1 is the label before the chunk; a text's first chunk has none to switch from.
    fence = np.where(number[:, None, None] > 0, penalty * (1 - np.eye(langs, dtype=np.float32)), np.float32(0))
    best = at(0)[:, None, :] - fence.astype(np.float32)
    longest = int(length.max())
    moved, source = np.zeros((longest, total, langs, langs), bool), np.zeros((longest, total, langs), np.int8)
    for t in range(1, longest):
        top = best.max(2, keepdims=True) - np.float32(penalty)
        np.greater(top, best, out=moved[t])
        source[t] = best.argmax(2)
        best = np.maximum(best, top) + at(t)[:, None, :]

    # Put chunks of a text together, then walk back.
    firsts = np.cumsum(counts) - counts
    before = np.zeros((total, langs), np.int64)
    value = np.zeros((len(sizes), langs), np.float64)
    for j in range(int(counts.max())):
        has = np.flatnonzero(counts > j)
        chunk = firsts[has] + j
        if j == 0:
            value[has] = best[chunk, 0]
        else:
            ways = value[has][:, :, None] + best[chunk]
            before[chunk] = ways.argmax(1)
            value[has] = ways.max(1)
    last, first = np.zeros(total, np.int64), np.zeros(total, np.int64)
    state = value.argmax(1)
    for j in range(int(counts.max()) - 1, -1, -1):
        has = np.flatnonzero(counts > j)
        chunk = firsts[has] + j
        last[chunk] = state[has]
        if j:
            state[has] = first[chunk] = before[chunk, state[has]]
    labels, now, rows = np.zeros((total, longest), np.int8), last.copy(), np.arange(total)
    for t in range(longest - 1, -1, -1):
        labels[:, t] = now
        if t:
            now = np.where(moved[t, rows, first, now], source[t, rows, first], now)
    inside = np.arange(longest)[None, :] < length[:, None]
    return labels[inside].astype(np.int64)


def _has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def identify(docs: DataFrame, model: Model, penalty: float = 12.0, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(row, lang_pred, score, spans): score is the predicted language's share of the letters, row the columns to keep.

    A span has a language and the numbers of its first word and of the word after its last.
    """
    held = docs.sparkSession.sparkContext.broadcast(tuple(model))
    span = pa.struct([("lang", pa.string()), ("first", pa.int64()), ("end", pa.int64())])

    def label(batches):
        model = Model(*held.value)
        for batch in batches:
            texts = batch.column(1)
            for words in split_words(texts):
                scores, letters = word_scores(words, model)
                labels = viterbi(scores, words.bounds, penalty)
                pred, score, spans = [], [], []
                for i in range(len(words.bounds) - 1):
                    a, b = words.bounds[i], words.bounds[i + 1]
                    share = np.bincount(labels[a:b], weights=letters[a:b], minlength=max(1, len(model.langs)))
                    if not model.langs or share.sum() == 0 or not _has_letter(texts[words.first + i].as_py()):
                        pred.append("und"), score.append(0.0), spans.append([])
                        continue
                    pred.append(model.langs[int(share.argmax())])
                    score.append(float(share.max() / share.sum()))
                    cut = [0, *(np.flatnonzero(np.diff(labels[a:b])) + 1).tolist(), int(b - a)]
                    spans.append([{"lang": model.langs[labels[a + x]], "first": x, "end": y} for x, y in zip(cut, cut[1:], strict=False)])
                rows = batch.column(0).slice(words.first, len(pred))
                yield pa.RecordBatch.from_arrays([rows, pa.array(pred), pa.array(score), pa.array(spans, pa.list_(span))], ["row", "lang_pred", "score", "spans"])

    chosen = docs.select(F.struct(*keep).alias("row"), "text")
    kind = chosen.schema["row"].dataType.simpleString()
    return chosen.mapInArrow(label, f"row {kind}, lang_pred string, score double, spans array<struct<lang: string, first: long, end: long>>")
