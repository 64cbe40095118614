import random

import pytest

from candlemill.llm.ngram_join import ngram_join
from tests.llm.brute import components, shingle_set, words

SCHEMA = "doc_id long, text string, n long, label string, gid string"


def run(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(docs, **options).collect()}


def expected(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t in rows}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return both > 0 and 100 * both >= percent * len(sets[a] | sets[b])

    low = components(sets, linked)
    return {i: (len(sets[i]), low[i]) for i in sets}


def near_copies(seed, n):
    draw = random.Random(seed)
    base = [draw.choice("abcdefghij") + str(draw.randrange(300)) for _ in range(120)]
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(draw.randrange(7)):
            own[draw.randrange(len(own))] = f"new{draw.randrange(10**6)}"
        rows.append((i * 3 + 1, " ".join(own)))
    return rows


def test_groups_edges_and_chains(spark):
    rows = near_copies(5, 60) + [
        (0, None), (2, ""), (5, " \n"), (8, "one two"), (11, "ONE\ttwo"), (14, "one two three"), (17, "w " * 5000),
        (20, "common line of words here " + "q1 q2 q3 q4 q5 q6 q7 q8"), (23, "common line of words here z1 z2 z3 z4 z5 z6 z7"),
        (1001, near_copies(5, 1)[0][1]),
    ]
    assert run(spark, rows, k=4, percent=85) == expected(rows, 4, 85)


def test_other_limits_without_sketch_or_stars(spark):
    rows = near_copies(6, 25) + near_copies(7, 12)[:0]
    assert run(spark, rows, k=5, percent=80, sketch_bits=6, star_rounds=0) == expected(rows, 5, 80)


def test_repeated_ids_and_nothing(spark):
    assert run(spark, []) == {}
    found = run(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")])
    assert found[1] == (2, 1) and found[2] == (2, 1) and None in found


@pytest.mark.parametrize("k", [4])
def test_the_smallest_table(spark, k):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert any(len(words(t)) > 1000 for _, t in rows)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(docs, k=k, percent=85).collect()}
    assert found == expected(rows, k, 85)
