"""Words of whole texts as 64-bit hashes, computed for a batch of texts at once in NumPy.

A word is a run of bytes other than \\x20 and \\x09-\\x0D, A-Z lower-cased. Hashes of different words differ but for a
chance of about 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on together; a longer text forms a piece of its own.
PIECE_BYTES = 1 << 20

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and ASCII punctuation.
GAPS = SPACE.copy()
GAPS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE_BYTES + 1), base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= PIECE_BYTES + 1:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words(NamedTuple):
    """Words of a piece of consecutive texts: text i of the piece has words bounds[i] to bounds[i + 1]."""

    first: int  # row of the batch the piece starts with
    hashes: np.ndarray  # a uint64 each
    bounds: np.ndarray
    starts: np.ndarray  # byte offsets into data
    ends: np.ndarray
    data: np.ndarray  # bytes of the texts as they are


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about PIECE_BYTES; every row is in one."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE_BYTES, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_marks(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, and bounds of texts in words; offsets begin at 0."""
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~gaps[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # between the last byte of a text and the first of the next
    starts = np.flatnonzero(word[1:] & (~word[:-1] | edge))
    ends = np.flatnonzero(word[:-1] & (~word[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def split_words(texts: pa.Array, gaps: np.ndarray = SPACE) -> Iterator[Words]:
    """The words of all texts, piece by piece, in order; `gaps` are the bytes that stand between words."""
    offsets, data = buffers(texts)
    for i, j in pieces(offsets):
        part = data[offsets[i] : offsets[j]]
        starts, ends, bounds = word_marks(part, offsets[i : j + 1] - offsets[i], gaps)
        total = np.zeros(len(part) + 1, U)
        np.cumsum((LOWER[part].astype(U) + U(1)) * powers(BASE, len(part)), out=total[1:])
        hashes = (total[ends] - total[starts]) * powers(BASE_INVERSE, len(part) + 1)[starts]
        yield Words(i, mix(hashes + (ends - starts).astype(U)), bounds, starts, ends, part)


def count_words(texts: pa.Array) -> np.ndarray:
    """Words of each text."""
    offsets, data = buffers(texts)
    counts = [np.diff(word_marks(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[2]) for i, j in pieces(offsets)]
    return np.concatenate(counts) if counts else np.zeros(0, np.int64)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for every run of k words in a row, across texts too; one less than k for each run's start at the end."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.zeros(n, U)
    for j in range(k):
        total = total * U(BASE) + hashes[j : j + n]
    return mix(total + U(k))


def shingles(words: Words, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its k-word shingles in order); fewer words form one shingle, none form none."""
    all_runs = runs(words.hashes, k)
    for i in range(len(words.bounds) - 1):
        a, b = int(words.bounds[i]), int(words.bounds[i + 1])
        if b - a >= k:
            yield words.first + i, all_runs[a : b - k + 1]
        else:
            yield words.first + i, runs(words.hashes[a:b], b - a) if b > a else np.zeros(0, U)
