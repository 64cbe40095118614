import itertools
import random

import numpy as np

from candlemill.llm import langid
from candlemill.llm.queries import fold


def test_viterbi_is_the_best_path():
    draw = np.random.default_rng(5)
    for _ in range(60):
        n = int(draw.integers(1, 8))
        scores = draw.normal(size=(n, 3)).astype(np.float32) * 4
        labels = langid.viterbi(scores, np.array([0, n]), 3.0)
        value = lambda p, s=scores: sum(s[i, x] for i, x in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        assert abs(value(labels) - max(value(p) for p in itertools.product(range(3), repeat=n))) < 1e-4


def test_chunks_change_nothing(monkeypatch):
    draw = np.random.default_rng(6)
    bounds = np.array([0, 0, 1, 700, 1300, 1300, 1600])
    scores = draw.normal(size=(1600, 4)).astype(np.float32) * 3
    whole = langid.viterbi(scores, bounds, 5.0)
    monkeypatch.setattr(langid, "CHUNK_WORDS", 9)
    assert (langid.viterbi(scores, bounds, 5.0) == whole).all()


def rows_of(n):
    draw = random.Random(8)
    kinds = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ein"], "ru": ["да", "не", "что"]}
    rows = []
    for i in range(n):
        lang = list(kinds)[i % 3]
        rows.append((i, " ".join("".join(draw.choice(kinds[lang]) for _ in range(2)) for _ in range(30)), lang))
    return rows


def test_held_out_mixed_and_edges(spark):
    docs = spark.createDataFrame([(*r, "s", "p") for r in rows_of(300)] + [(900, None, "aa", "", ""), (901, "kalo", None, "", "")], "doc_id long, text string, lang string, row string, lang_pred string")
    model = langid.train(docs.where(fold(5) != 0))
    assert model.langs == ["aa", "bb", "ru"]
    found = {r.row.doc_id: r for r in langid.identify(docs, model).collect()}
    assert all(found[i].lang_pred == lang and found[i].score == 1.0 for i, _, lang in rows_of(300))
    assert (found[900].lang_pred, found[900].score, found[900].spans) == ("und", 0.0, [])
    odd = [(1, ""), (2, "12 34 !?"), (3, "kalo mika loka kami schein ungein schung einung"), (4, "kalo " * 60_000 + "да"), (5, "１２ …"), (6, "数 ка"), (3, "kalo mika loka kami schein ungein schung einung")]
    out = langid.identify(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()
    by = {r.row.doc_id: r for r in out}
    assert len(out) == len(odd) and [by[i].lang_pred for i in (1, 2, 5)] == ["und"] * 3
    assert [(s.lang, s["first"], s.end) for s in by[3].spans] == [("aa", 0, 4), ("bb", 4, 8)]
    assert by[4].lang_pred == "aa" and by[4].spans[-1].lang == "ru" and by[6].lang_pred == "ru"


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.langs == [] and langid.identify(docs, model).count() == 0
    assert langid.identify(spark.createDataFrame([(1, "text")], "doc_id long, text string"), model).first().lang_pred == "und"
