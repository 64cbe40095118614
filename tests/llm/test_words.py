import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from candlemill.llm import words as w
from tests.llm.brute import shingle_set, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZé 漢\t\n\x0b\x1f.", max_size=40)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_shingles(texts):
    assert w.count_words(pa.array(texts, pa.string())).tolist() == [len(words(t)) for t in texts]
    seen, hashes = [], {}
    for part in w.split_words(pa.array(texts, pa.string())):
        for i in range(len(part.bounds) - 1):
            own = part.hashes[part.bounds[i] : part.bounds[i + 1]]
            for word, value in zip(words(texts[part.first + i]), own.tolist(), strict=True):
                assert hashes.setdefault(word, value) == value
        for row, found in w.shingles(part, 3):
            seen.append(row)
            assert len(set(found.tolist())) == len(shingle_set(texts[row], 3))
    assert len(set(hashes.values())) == len(hashes) and seen == list(range(len(texts)))


def test_sliced_batches_and_long_texts():
    texts = pa.array(["skip", "a b c", None, "x " * 900_000, "tail"])[1:]
    assert w.count_words(texts).tolist() == [3, 0, 900_000, 1]
    assert [p.first for p in w.split_words(texts)] == [0, 2, 3]


def test_equal_words_in_different_pieces():
    one, two = (next(iter(w.split_words(pa.array([t])))).hashes for t in ("zz Hello", "hello"))
    assert one[1] == two[0] and one[0] != two[0] and one.dtype == np.uint64
