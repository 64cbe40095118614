import random

from candlemill.llm.graph import components as find
from candlemill.llm.scratch import Scratch
from tests.llm.brute import components


def test_components(spark):
    draw = random.Random(3)
    links = {(draw.randrange(80), draw.randrange(80)) for _ in range(50)} | {(100 + i, 101 + i) for i in range(40)} | {(7, 7)}
    found = find(Scratch(spark), spark.createDataFrame(sorted(links), "a long, b long")).collect()
    ids = {x for a, b in links if a != b for x in (a, b)}
    assert {r.id: r.component for r in found} == components(ids, lambda a, b: (a, b) in links or (b, a) in links)
    assert len(found) == len(ids)


def test_no_links(spark):
    assert find(Scratch(spark), spark.createDataFrame([], "a long, b long")).count() == 0
