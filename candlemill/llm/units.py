"""Texts as units a tokenizer treats one by one, so that each different unit is encoded once by a task.

A text is cut at single spaces between two characters that are not white space. Byte-level BPE splits text before its
merges, always in front of such a space; BPE over pieces never joins across one as long as no piece has a space behind
another character. A unit's tokens with the space before it are then the same in every text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters of text that are split together; a longer text is split piece by piece.
SEGMENT = 1 << 22
#: Units of which a task keeps the tokens before it starts anew; longer ones than LONGEST are not looked up again.
MOST_UNITS = 1 << 19
LONGEST = 128
#: Units that are encoded as one text.
RUN = 256


def load_tokenizer(path: str):
    """A tokenizer of the tokenizers library that leaves the other cores to Spark's other tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_units(tokenizer, units: list[str], leads: np.ndarray, plain: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units, each with a space before it, one after the other; and how many each has.

    Plain units, those without a space or white space at an end, are encoded many in one text: there a token that leads
    with a space, as `leads` says of every id, begins a unit. Others are encoded one by one.
    """
    texts = [" " + " ".join(units[i : i + RUN]) for i in range(0, len(units), RUN)] if plain else [" " + u for u in units]
    found = [np.array(e.ids, np.int64) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    ids = np.concatenate(found) if found else np.zeros(0, np.int64)
    if not plain:
        return ids, np.array([len(f) for f in found], np.int64)
    first = np.flatnonzero(leads[ids])
    if len(first) != len(units):
        return encode_units(tokenizer, units, leads, False)
    return ids, np.diff(np.r_[first, len(ids)])


def splits_before_spaces(tokenizer) -> bool:
    """Whether a tokenizer of the tokenizers library is plain byte-level BPE, so that `CUT` changes no id."""
    made = json.loads(tokenizer.to_str())
    before, added = made.get("pre_tokenizer") or {}, made.get("added_tokens") or []
    plain = made["model"].get("type") == "BPE" and not made["model"].get("dropout") and before.get("type") == "ByteLevel"
    plain = plain and before.get("use_regex", True) and not before.get("add_prefix_space")
    return bool(plain and not made.get("normalizer") and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added))


def pieces_keep_spaces_first(pieces: list[str]) -> bool:
    """Whether no piece has a space, written as U+2581, behind another character."""
    return not any("▁" in p.lstrip("▁") for p in pieces)


def segments(text: str) -> Iterator[str]:
    """Parts of about SEGMENT characters that a space joins to the text again, cut where units end."""
    start = 0
    while len(text) - start > SEGMENT and (m := CUT.search(text, start + SEGMENT)):
        yield text[start : m.start()]
        start = m.end()
    yield text[start:]


class Units:
    """Numbers of units, given by `make`, which gets lists of different units and whether all are plain (`encode_units`).

    A task splits pieces of text and finds their different units in Arrow, and remembers those that are short and plain.
    """

    def __init__(self, make: Callable[[list[str], bool], list[int]], cut: bool = True) -> None:
        self.make, self.cut = make, cut
        self.known: dict[str, int] = {}

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The numbers of the units of all texts, one text after the other; bounds of texts; the first unit of each.

        `texts` are large strings without nulls.
        """
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(1, np.int64), []
        if not self.cut:
            whole = texts.to_pylist()
            return np.array(self.make(whole, False), np.int64), np.arange(len(texts) + 1), whole
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        code, bounds = coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        units = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        firsts = [units[c] for c in code[bounds[:-1]].tolist()]
        number = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        new = [(i, units[i]) for i in np.flatnonzero(number < 0).tolist()]
        # Units with white space at an end come from spaces next to white space or from the ends of a text.
        plain = [(i, u) for i, u in new if u and len(u) <= LONGEST and u.strip() == u]
        made = self.make([u for _, u in plain], True)
        number[[i for i, _ in plain]] = made
        self.known.update(zip((u for _, u in plain), made, strict=True))
        found = number[code]
        odd = np.unique(np.searchsorted(bounds, np.flatnonzero(found < 0), "right") - 1).tolist()
        if odd:
            parts = [CUT.split(texts[i].as_py()) for i in odd]
            rest = list(set().union(*parts))
            own = dict(zip(rest, self.make(rest, False), strict=True))
            pieces = np.split(found, bounds[1:-1])
            for i, part in zip(odd, parts, strict=True):
                pieces[i] = np.array([own[u] for u in part], np.int64)
                firsts[i] = part[0]
            found, bounds = np.concatenate(pieces), np.r_[0, np.cumsum([len(p) for p in pieces])]
        return found, bounds, firsts


class Store:
    """Rows of different lengths, by number, in arrays that grow."""

    def __init__(self, columns: int = 1) -> None:
        self.rows = 0
        self._bounds = [np.zeros(1, np.int64)]
        self._columns = [[np.zeros(0, np.int64)] for _ in range(columns)]

    def add(self, sizes: np.ndarray, *columns: np.ndarray) -> list[int]:
        """Numbers of new rows of these sizes, whose values follow each other."""
        first = self.rows
        if not len(sizes):
            return []
        self.rows += len(sizes)
        self._bounds.append(self._bounds[-1][-1] + np.cumsum(sizes))
        for column, values in zip(self._columns, columns, strict=True):
            column.append(values)
        return list(range(first, self.rows))

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sizes and values of some rows, one after the other."""
        for parts in (self._bounds, *self._columns):
            parts[:] = [np.concatenate(parts)]
        bounds = self._bounds[0]
        sizes = bounds[rows + 1] - bounds[rows]
        at = ranges(bounds[rows], sizes)
        return sizes, *(c[0][at] for c in self._columns)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def pieces_of(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive texts of about SEGMENT bytes together, with the number of the first; null counts as empty."""
    texts = column.cast(pa.large_string()).fill_null("")
    upto = np.cumsum(pc.binary_length(texts).to_numpy())
    first = 0
    while first < len(texts):
        after = int(np.searchsorted(upto, (upto[first - 1] if first else 0) + SEGMENT)) + 1
        yield first, texts[first:after]
        first = after


def in_segments(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Segments of all texts, and the text each belongs to."""
    if not len(texts) or pc.max(pc.binary_length(texts)).as_py() <= SEGMENT:
        return texts, np.arange(len(texts))
    parts = [(i, s) for i, t in enumerate(texts.to_pylist()) for s in segments(t)]
    return pa.array([s for _, s in parts], pa.large_string()), np.array([i for i, _ in parts])
