import random

import numpy as np

from candlemill.llm.decontaminate import Items, contaminated

DOCS, ITEMS = "doc_id long, text string, item_id int, first string", "item_id long, text string, doc_id int"


def run(spark, docs, items, **options):
    table = spark.createDataFrame([(*d, 1, "f") for d in docs], DOCS)
    return {(r.doc_id, r.item_id, r.first, r.n_words): r.similarity for r in contaminated(table, spark.createDataFrame([(*i, 1) for i in items], ITEMS), **options).collect()}


def sample():
    draw = random.Random(9)
    word = lambda: f"w{draw.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(draw.randrange(12, 60)))) for i in range(30)]
    text = [word() for _ in range(200)]
    long = [word() for _ in range(50)]
    edited = [*long[:10], "changed", *long[11:]]
    docs = [(1, " ".join(text)), (2, " ".join(text[:70]) + " " + items[3][1] + " " + " ".join(text[70:])), (3, items[4][1].upper().replace(" ", ", ") + "!")]
    docs += [(4, " ".join(text[:20] + edited + text[20:])), (5, " ".join(text[:9]) + " " + " ".join(items[5][1].split()[:6])), (6, items[6][1] + " gap " + items[6][1])]
    items += [(40, " ".join(long)), (41, None), (42, ""), (43, "short item"), (44, items[3][1]), (45, "... !")]
    docs += [(7, None), (8, ""), (9, "a short, item here"), (10, "filler " * 60_000 + items[7][1]), (1, " ".join(text)), (None, items[8][1])]
    return docs, items


def test_planted_passages(spark):
    docs, items = sample()
    found = run(spark, docs, items)
    size = {i: len((t or "").split()) for i, t in items}
    want = {(2, 3, 70, size[3]), (2, 44, 70, size[3]), (3, 4, 0, size[4]), (4, 40, 20, 50), (6, 6, 0, size[6]), (6, 6, size[6] + 1, size[6]), (9, 43, 1, 2), (10, 7, 60_000, size[7]), (None, 8, 0, size[8])}
    assert set(found) == want
    assert found[4, 40, 20, 50] == (46 - 5) / (46 + 5) and found[2, 3, 70, size[3]] == 1.0


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    docs, items = sample()
    whole = run(spark, docs, items)
    monkeypatch.setattr("candlemill.llm.decontaminate.BLOCK_ITEMS", 7)
    assert run(spark, docs, items) == whole


def test_nothing(spark):
    docs, items = sample()
    assert run(spark, [], items) == {} and run(spark, docs, []) == {}


def test_the_index_misses_no_fingerprint():
    draw = np.random.default_rng(3)
    items = Items(list(range(50)), [" ".join(f"x{draw.integers(10**6)}" for _ in range(20)) for _ in range(50)], 5, 19)
    prints = draw.integers(0, 2**64, 4000, dtype=np.uint64, endpoint=False)
    for i in range(0, 4000, 4):
        flips = draw.choice(64, draw.integers(0, 24), replace=False)
        prints[i] = items.prints[i % 50] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64), initial=np.uint64(0))
    window, item = items.look_up(prints)
    near = np.bitwise_count(prints[:, None] ^ items.prints[None, :]) <= 19
    assert set(zip(window.tolist(), item.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))
