import random

import numpy as np
import pyarrow as pa

from candlemill.llm import toxicity


def corpus(n, seed):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice(["ka", "lo", "mi", "ter", "on", "sa"]) for _ in range(draw.randrange(1, 4))) for _ in range(400)]
    bad = ["vermin", "lowlife", "cretin"]
    rows = []
    for i in range(n):
        words = [draw.choice(vocabulary) for _ in range(draw.randrange(5, 120))]
        toxic = int(i % 4 == 0)
        for _ in range(2 * toxic):
            words[draw.randrange(len(words))] = draw.choice(bad)
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_and_misspelled(spark):
    rows = corpus(1200, 1)
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows], "doc_id long, text string, toxic string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i < 800] + [(0, 0, 0), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    found = {r.doc_id: r for r in toxicity.score_texts(docs, model).collect()}
    hits = [(found[i].score >= 0.7) == (y == 1) for i, _, y in rows if i >= 800]
    assert sum(hits) / len(hits) >= 0.95
    extra = [(1, "ka lo mi verrmin ter on"), (2, "ka lo mi mister ter on"), (3, None), (4, ""), (5, "ka " * 50_000 + "cretin"), (6, "ka lo"), (6, "ka lo")]
    scored = toxicity.score_texts(spark.createDataFrame(extra, "doc_id long, text string"), model).collect()
    score = {r.doc_id: r.score for r in scored}
    assert score[1] > 5 * score[2] and score[3] == score[4] and score[5] >= 0.7 and len(scored) == len(extra)
    assert all(0 <= r.score <= 1 for r in scored)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    assert [r.score for r in toxicity.score_texts(docs, model).collect()] == [0.5, 0.5]
    one = toxicity.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert all(r.score > 0.99 for r in toxicity.score_texts(docs, one).collect())
    assert toxicity.score_texts(docs.limit(0), model).count() == 0


def test_windows():
    window, limits = toxicity._windows(np.array([0, 0, 3, 13, 14]))
    assert limits.tolist() == [0, 0, 1, 4, 5] and np.bincount(window).tolist() == [3, 4, 4, 2, 1]
    assert [len(p[1]) for p in toxicity._bags(pa.array(["a b c d e f", None]))] == [3]


def test_labels_without_a_usable_document_take_no_place_in_the_sample(spark, monkeypatch):
    rows = corpus(300, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(400 + i, None) for i in range(300)], "doc_id long, text string")
    own = [(i, y) for i, _, y in rows]
    foreign = [(400 + i, i % 2) for i in range(3000)]
    of = lambda labels: toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), most_rows=40)
    one, two = of(own), of(own + foreign)
    assert np.array_equal(one[0], two[0]) and one[1] == two[1] and one[0].any()
    # Bytes bound the sample besides rows.
    monkeypatch.setattr(toxicity, "MOST_BYTES", 10)
    assert not of(own)[0].any()
