import numpy as np
import pytest

from candlemill.llm import whitening
from candlemill.llm.whitening import jacobi_davidson, minres, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x string, c string, n int"


def run(spark, rows):
    found = whiten(spark.createDataFrame([(i, v, 0, "x", "c", 1) for i, v in rows], SCHEMA))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return found.collect()


def plain(rows):
    """The same by a dense covariance of the distinct whole vectors, for rows that all take part."""
    x = [tuple(int(np.floor(256 * float(np.float32(c)))) for c in v) for _, v in rows]
    fit = np.array(sorted(set(x)), dtype=object)
    n, s = len(fit), fit.sum(0)
    centred = np.array(fit - s / n, float)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    dev = [int(((n * np.array(v, dtype=object) - s) ** 2).sum()) for v in x]
    return n, dev, e, np.array(np.array(x, dtype=object) - s / n, float) @ u / np.sqrt(np.where(e > 0, e, 1)), e / e.sum()


def test_against_dense_covariance(spark):
    draw = np.random.default_rng(3)
    rows = [(i, (draw.normal(size=24) * np.linspace(2, 0.1, 24) + 5).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(5000 + i, rows[7][1]) for i in range(700)] + [(None, rows[8][1])]
    bad = [(-1, None), (-2, [float("nan")] * 24), (-3, [None] + [1.0] * 23), (-4, [float("-inf")] + [0.0] * 23), (-5, []), (-6, [3e38] * 24)]
    found = run(spark, rows + bad)
    n, dev, e, w, part = plain(rows)
    at = {}
    for k, (i, _) in enumerate(rows):
        at.setdefault(i, k)
    assert len(found) == 4 * len(rows)
    sign = {r.component: np.sign(r.whitened * w[0, r.component - 1]) for r in found if r.vec_id == 0}
    for r in found:
        k, j = at[r.vec_id], r.component - 1
        assert (r.n, int(r.deviation)) == (n, dev[k])
        assert abs(r.whitened * sign[r.component] - w[k, j]) < 1e-9
        assert abs(r.explained / part[j] - 1) < 1e-10 and r.identity_error < 1e-9


def test_close_and_equal_eigenvalues():
    draw = np.random.default_rng(5)
    for dim, values in ((40, np.r_[9, 9, 9, 9, 9, 1, np.zeros(34)]), (60, np.linspace(3, 2.9, 60)), (5, np.r_[5, 4, 3, 2, 1]), (3, np.r_[1, 0, 0]), (50, np.r_[1e12, 1e6, 1, 1e-3, np.zeros(46)])):
        q = np.linalg.qr(draw.normal(size=(dim, dim)))[0]
        a = (q * values) @ q.T
        e, u = jacobi_davidson(lambda x, a=a: a @ x, dim, min(4, dim))
        want = np.linalg.eigvalsh(a)[::-1][: len(e)]
        assert np.abs(e - want).max() <= 1e-13 * values.max() and np.abs(u.T @ u - np.eye(len(e))).max() < 1e-13
        assert np.linalg.norm(a @ u - u * e, axis=0).max() <= 64 * whitening.EPS * values.max()


def test_minres():
    draw = np.random.default_rng(6)
    a = draw.normal(size=(12, 12))
    a, b = a + a.T, draw.normal(size=(12, 3))
    assert np.abs(a @ minres(lambda x: a @ x, b, 12, 1e-12) - b).max() < 1e-8
    short = [np.linalg.norm(a @ minres(lambda x: a @ x, b, k, 0) - b, axis=0) for k in range(1, 8)]
    assert all((y <= x + 1e-12).all() for x, y in zip(short, short[1:], strict=False))
    assert (minres(lambda x: a @ x, np.zeros((12, 2)), 3, 0.1) == 0).all()


def test_jacobi_davidson_gives_up_loudly(monkeypatch):
    monkeypatch.setattr(whitening, "MOST_ROUNDS", 2)
    a = np.diag(np.linspace(1, 2, 400))
    with pytest.raises(RuntimeError):
        jacobi_davidson(lambda x: a @ x, 400, 4)


def test_no_variance_other_lengths_and_nothing(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, [])]) == []
    same = run(spark, [(i, [1.5, -0.0, -2.0]) for i in range(4)])
    assert sorted((r.vec_id, r.component) for r in same) == [(i, c) for i in range(4) for c in (1, 2, 3)]
    assert {(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, None, 0.0, 0.0)}
    two = run(spark, [(1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, [7.0]), (4, [9.0]), (5, [11.0])])
    assert {(r.vec_id, r.component, r.n) for r in two} == {(1, 1, 2), (1, 2, 2), (2, 1, 2), (2, 2, 2), (3, 1, 3), (4, 1, 3), (5, 1, 3)}
    first = {r.vec_id: abs(r.whitened) for r in two if r.component == 1}
    assert abs(first[1] - 1) < 1e-12 and abs(first[2] - 1) < 1e-12 and abs(first[4]) < 1e-12
    assert all(r.whitened is None and r.explained == 0 for r in two if r.component == 2)


def test_very_large_entries(spark):
    huge = 2.0**54
    rows = [(1, [huge, 1.0]), (2, [-huge, 2.0]), (3, [0.0, 3.0])]
    found = run(spark, rows)
    n, dev, _, w, _ = plain(rows)
    for r in found:
        if r.component == 1:
            want = dev[r.vec_id - 1]
            assert (r.deviation is None and want >= 10**38) or int(r.deviation) == want
            assert abs(abs(r.whitened) - abs(w[r.vec_id - 1, 0])) < 1e-9
