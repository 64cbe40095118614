import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from candlemill.llm import token_align, units
from candlemill.llm.token_align import Aligner, align_tokens, byte_letters, coalesce, linked_pairs, piece_bytes
from tests.llm.test_token_files import odd_texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, row long, pairs string, n_a int"


@pytest.fixture(scope="module")
def plain_groups():
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = byte_letters()

    def groups(text):
        """[(ids of A, ids of B)] by walking along both sides; none where the bytes differ."""
        if not text:
            return []
        x = a.encode(" " + text, add_special_tokens=False)
        x = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in x.ids]
        y = [(i, piece_bytes(b.id_to_piece(i))) for i in b.encode(text)]
        want = b" " + text.encode()
        if b"".join(t for _, t in x) != want or b"".join(t for _, t in y) != want:
            return []
        ends = [np.cumsum([len(t) for _, t in side]).tolist() for side in (x, y)]
        common = sorted(set(ends[0]) & set(ends[1]))
        found, before = [], 0
        for e in common:
            found.append(tuple([i for (i, _), end in zip(side, own, strict=True) if before < end <= e] for side, own in zip((x, y), ends, strict=True)))
            before = e
        return found

    return groups


def plain(docs, groups):
    each = [groups(t) for _, t in docs]
    linked = [Counter((i, j) for x, y in g for i in x for j in y) for g in each]
    count = Counter(p for c in linked for p in c)
    most = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    out = []
    for (doc_id, _), g, c in zip(docs, each, linked, strict=True):
        digest = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        best = sum(n for p, n in c.items() if count[p] == most[p[0]])
        out.append((doc_id, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), best, sum(n * count[p] for p, n in c.items()), hashlib.sha256(digest.encode()).hexdigest() if g else ""))
    return out


def cases():
    texts = odd_texts(160, 11) + ["naïve café über straße " * 3, "international internationalization tokenizers " * 20, "no▁break", "<s> </s> <unk> <0x41> <|endoftext|>", "🙂🙂 🙂", "=" * 300, "aaaaaaa" * 90, "\x00", " lead", "trail ", None, ""]
    rows = list(enumerate(texts)) + [(3, "same id"), (None, "no id"), (None, None)] + [(1000 + i, "copied words here") for i in range(30)]
    random.Random(12).shuffle(rows)
    return rows


@pytest.mark.parametrize("hot_pairs", [token_align.HOT_PAIRS, 40, 0])
def test_against_plain(spark, plain_groups, hot_pairs):
    rows = cases()
    docs = spark.createDataFrame([(i, t, 5, "p", 1) for i, t in rows], SCHEMA).repartition(4)
    found = align_tokens(docs, A, B, hot_pairs)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain(rows, plain_groups), key=str)


def test_segments_and_forgetting_change_nothing(plain_groups, monkeypatch):
    monkeypatch.setattr(units, "SEGMENT", 25)
    aligner = Aligner(A, B)
    aligner.most = 10
    texts = [t for _, t in cases() if t]
    for first in range(0, len(texts), 20):
        some = texts[first : first + 20]
        facts, digests, bounds, keys, links = aligner.documents(pa.array(some, pa.large_string()))
        for k, text in enumerate(some):
            g = plain_groups(text)
            want = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
            assert digests[k] == (hashlib.sha256(want.encode()).hexdigest() if g else "")
            assert facts[k].tolist() == [sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(len(x) * len(y) for x, y in g)]
            pairs = Counter(i * aligner.pair.size_b + j for x, y in g for i in x for j in y)
            assert dict(zip(keys[bounds[k] : bounds[k + 1]].tolist(), links[bounds[k] : bounds[k + 1]].tolist(), strict=True)) == pairs


def test_coalesce():
    end_a, end_b = np.array([2, 5, 6, 9]), np.array([3, 5, 9])
    a, b, n = coalesce(np.r_[0, end_a[:-1]], end_a, np.r_[0, end_b[:-1]], end_b)
    assert (a.tolist(), b.tolist(), n) == ([0, 0, 1, 1], [0, 0, 1], 2)
    empty = np.zeros(0, np.int64)
    assert coalesce(empty, empty, empty, empty)[2] == 0


def test_large_groups_are_expanded_by_ids(monkeypatch):
    draw = np.random.default_rng(2)
    group_a, group_b = np.sort(draw.integers(0, 6, 200)), np.sort(draw.integers(0, 6, 300))
    ids_a, ids_b, owner = draw.integers(0, 9, 200), draw.integers(0, 9, 300), np.array([0, 0, 1, 1, 1, 2])
    want = Counter((int(owner[g]), int(i) * 10 + int(j)) for g, i in zip(group_a, ids_a, strict=True) for h, j in zip(group_b, ids_b, strict=True) if g == h)
    for large, at_once in ((1, 50), (2000, 10**6), (10**9, 7)):
        monkeypatch.setattr(token_align, "LARGE_GROUP", large)
        monkeypatch.setattr(token_align, "LINKS_AT_ONCE", at_once)
        who, keys, links = linked_pairs(group_a, ids_a, group_b, ids_b, 6, owner, 10)
        assert dict(zip(zip(who.tolist(), keys.tolist(), strict=True), links.tolist(), strict=True)) == want


def test_nothing(spark):
    assert align_tokens(spark.createDataFrame([], SCHEMA), A, B).collect() == []
