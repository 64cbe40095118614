from collections import defaultdict

from candlemill.llm.mixing import mix_sources
from tests.llm.brute import words

SCHEMA = "doc_id long, text string, source string, size string, row string, copies string"


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "s", "r", "c") for r in rows], SCHEMA)
    return mix_sources(docs).select("row.doc_id", "source", "size", "source_size", "target", "copies").collect()


def targets(rows, weights=(1, 2, 3), cap=3):
    """Fill up by weight, hold sources at their cap, share out the excess until none is above."""
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += len(words(text))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, held = sum(size.values()), set()
    while True:
        left = total - sum(cap * size[s] for s in held)
        free = sum(weight[s] for s in order if s not in held)
        share = {s: cap * size[s] if s in held else left * weight[s] / free for s in order}
        above = {s for s in order if s not in held and share[s] > cap * size[s]}
        if not above:
            return share
        held |= above


def sample():
    rows = [(i, " ".join(["w"] * (i * i % 97)), f"s{i % 4}") for i in range(200)]
    rows += [(500 + i, "tiny source here", "rare") for i in range(3)] + [(600, "a b", None), (601, None, None), (602, "", "blank")]
    rows += [(700 + i, "one of many copies", "s1") for i in range(2000)] + [(700, "one of many copies", "s1")]
    return rows + [(9999, "long " * 300, "s2")]


def test_targets_copies_and_reruns(spark):
    rows = sample()
    found = run(spark, rows)
    assert len(found) == len(rows)
    want = targets(rows)
    taken = defaultdict(int)
    for r in found:
        assert abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source])
        assert 0 <= r.copies <= 3 and r.size == len(words(dict((i, t) for i, t, _ in rows)[r.doc_id]))
        taken[r.source] += r.copies * r.size
    for source, words_taken in taken.items():
        assert abs(words_taken - want[source]) <= 3, source
    key = lambda r: (r.doc_id, r.copies)
    assert sorted(map(key, found)) == sorted(map(key, run(spark, list(reversed(rows)))))


def test_nothing(spark):
    assert run(spark, []) == []
    assert [r.copies for r in run(spark, [(1, None, "a")])] == [0]
