import numpy as np

from candlemill.llm import embeddings
from candlemill.llm.embeddings import blocks_and_rounds, forest, near_duplicates, reaches, similar
from tests.llm.brute import components

SCHEMA = "vec_id long, embedding array<float>, label int, unit string, cls string"


def run(spark, rows):
    table = spark.createDataFrame([(i, v, 0, "u", "c") for i, v in rows], SCHEMA)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(table).collect()}


def test_against_all_pairs(spark):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(6, 12))
    rows = [(int(i), (centres[i % 6] + draw.normal(size=12) * draw.choice([0.05, 0.25, 1.0])).astype(np.float32).tolist()) for i in draw.permutation(150)]
    rows += [(200 + i, rows[0][1]) for i in range(30)] + [(300, [2 * v for v in rows[0][1]]), (301, rows[1][1][:5]), (302, [-v for v in rows[0][1]])]
    bad = [(400, None), (401, [0.0] * 12), (402, [float("nan")] * 12), (403, [None] + [1.0] * 11), (404, []), (405, [float("inf")] * 12)]
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in rows}
    linked = lambda a, b: len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= 0.95
    low = components(unit, linked)
    want = {a: (sum(linked(a, b) for b in unit if b != a), low[a], low[a] == a) for a in unit} | {i: (0, i, True) for i, _ in bad}
    assert run(spark, rows + bad) == want


def test_nothing(spark):
    assert run(spark, []) == {} and run(spark, [(3, None)]) == {3: (0, 3, True)}


def test_bounds_lose_no_pair():
    draw = np.random.default_rng(2)
    for dim in (3, 8, 40):
        a, b = (draw.normal(size=(n, dim)) * np.linspace(3, 0.1, dim) for n in (60, 80))
        a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
        for least in (0.5, 0.9):
            assert set(zip(*map(list, similar(a, b, least)), strict=True)) == set(zip(*map(list, np.nonzero(a @ b.T >= least)), strict=True))


def test_forest():
    left, right = forest(np.array([0, 1, 3, 3]), np.array([2, 2, 0, 1]), 5, 4)
    assert left.tolist() == [0, 0, 5, 3, 5] and right.tolist() == [3, 3, 0, 5]


def test_null_ids_link_with_nothing(spark):
    big = 2**60 + 1
    rows = [(None, [1.0, 0.0, 0.0, 0.01]), (big, [1.0, 0.0, 0.0, 0.0]), (big + 2, [1.0, 0.01, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]), (None, None)]
    found = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in found if r.vec_id) == [(big, 1, big, True), (big + 2, 1, big, False)]
    assert [(r.n_links, r.component_id, r.kept) for r in found if r.vec_id is None] == [(0, None, True)] * 3


def test_cosines_at_the_threshold(spark):
    """Pairs of whole-number vectors whose cosine is 19/20 exactly, each pair in dimensions of its own."""
    draw = np.random.default_rng(7)
    a = np.array([5, 2, 3, 1, 0, 0])  # its square is 39, so that 19 k a + 39 c has the cosine, for c across a of length k
    placed = []
    for at in range(60):
        p, q, k = ((3, 4, 5), (5, 12, 13), (8, 15, 17), (20, 21, 29), (0, 7, 7))[at % 5]
        b = 19 * k * a + 39 * np.array([0, 0, 0, 0, p, q])
        assert 400 * int(a @ b) ** 2 == 361 * 39 * int(b @ b)
        for i, v in enumerate((a * int(draw.integers(1, 50)), b, 3 * b)):
            x = np.zeros(360)
            x[6 * at : 6 * at + 6] = v
            placed.append((10 * at + i, x.tolist()))
    found = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(spark.createDataFrame(placed, "vec_id long, embedding array<double>")).collect()}
    assert found == {i: (2, i // 10 * 10) for i, _ in placed}
    assert not reaches(np.array([1.0, 0.0]), np.array([0.95, np.sqrt(1 - 0.95**2) + 1e-12]), 0.95)
    assert reaches(np.array([1.0, 0.0]), np.array([0.95, np.sqrt(1 - 0.95**2) - 1e-12]), 0.95)
    assert not reaches(np.array([1.0, 0.0]), np.array([-1.0, 0.0]), 0.95)


def test_blocks_in_rounds(spark, monkeypatch):
    """Many tiles in many blocks: every near pair of tiles meets in one round, as all pairs of vectors show."""
    monkeypatch.setattr(embeddings, "TILE_ROWS", 8)
    monkeypatch.setattr(embeddings, "BLOCK_BYTES", 2048)
    monkeypatch.setattr(embeddings, "ROUND_COPIES", 5)
    draw = np.random.default_rng(11)
    centres = draw.normal(size=(5, 6))
    rows = [(int(i), (centres[i % 5] + draw.normal(size=6) * draw.choice([0.1, 0.4])).tolist()) for i in draw.permutation(300)]
    unit = {i: np.array(np.float32(v), float) / np.linalg.norm(np.float32(v).astype(float)) for i, v in rows}
    linked = lambda a, b: float(unit[a] @ unit[b]) >= 0.95
    low = components(unit, linked)
    assert run(spark, rows) == {a: (sum(linked(a, b) for b in unit if b != a), low[a], low[a] == a) for a in unit}


def test_copies_of_a_round_do_not_grow():
    few, many = (blocks_and_rounds(n * 512, 12) for n in (50_000, 50_000_000))
    assert few == (7, 2) and many[0] == 1526
    assert all(blocks / rounds <= embeddings.ROUND_COPIES for blocks, rounds in (few, many))


def test_a_pair_alone_in_its_tile(spark):
    chain = [[1.0, 0.0, 0.0], [1.0, 0.3, 0.0], [1.0, 0.6, 0.0], [0.0, 0.0, 1.0], [0.0, 0.1, 1.0]]
    assert run(spark, list(enumerate(chain))) == {0: (1, 0, True), 1: (2, 0, False), 2: (1, 0, False), 3: (1, 3, True), 4: (1, 3, False)}
