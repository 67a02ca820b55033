import random

import pytest

from hyperweave.operators import blocks as bl


@pytest.mark.parametrize("neighbours,least", [(4, 3), (2, 2)])
def test_blocks_are_disjoint_and_no_further_one_fits(spark, neighbours, least):
    rng = random.Random(neighbours)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(120)] + [(100, 101), (200 + 0, 201), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    rows = bl.draw_blocks(df, 3, neighbours, least).collect()
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    blocks = {}
    for r in rows:
        blocks.setdefault(r.seed, set()).add(r.node)
    held = [v for own in blocks.values() for v in own]
    assert len(held) == len(set(held)) and blocks
    for seed, own in blocks.items():
        assert seed in own and own - {seed} <= near[seed] and least <= len(own) <= neighbours + 1
    free = set(near) - set(held)
    assert all(len(near[v] & free) < least - 1 for v in free)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, bl.draw_blocks(df, 3, neighbours, least).collect()))
    assert sorted(map(tuple, rows)) != sorted(map(tuple, bl.draw_blocks(df, 4, neighbours, least).collect()))


def test_eligible_nodes_only_and_no_edges(spark):
    df = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (4, 5), (4, 6)], "a long, b long")
    only = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    assert {r.node for r in bl.draw_blocks(df, 1, eligible=only).collect()} == {1, 2, 3}
    assert bl.draw_blocks(df.limit(0), 1).collect() == []
