import numpy as np
import pytest

from hyperweave.llm import topk


def brute(rows, k=10, every=100):
    out = []
    fine = [(i, [int(np.floor(np.float64(x) * 1024)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for i, q in fine:
        if i % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine if j != i and len(v) == len(q))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_equals_brute_force_over_many_shards_and_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=5), 1)]) for i in range(900)]  # many ties
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # copies of a query
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(topk.top_k(df, shard_bytes=3000, block_bytes=160)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -1.0]), (100, [0.0, 0.0]), (200, None), (300, []), (400, [nan, 1.0]), (500, [inf, 1.0]), (600, [None, 1.0])]
    rows += [(None, [1.0, 1.0]), (1, [2.0, 1.0]), (2, [2.0, 1.0]), (3, [2.0, 1.0, 4.0]), (700, [1.0, 2.0, 3.0]), (-100, [0.5, 0.25])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    assert found(topk.top_k(df)) == brute(rows)
    assert topk.top_k(df.limit(0)).collect() == []


def test_rows_that_share_an_id_are_queries_of_their_own(spark):
    df = spark.createDataFrame([(100, [1.0]), (100, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert found(topk.top_k(df)) == [(100, 1, 1, 2 << 20), (100, 1, 1, 2 << 20), (100, 2, 1, 2 << 20), (100, 2, 1, 2 << 20)]


def test_numbers_too_large_for_double_precision_are_exact(spark):
    rows = [(0, [3e12, 1.0]), (1, [3e12, 1.0]), (2, [3e12, 2.0]), (3, [1e305, -1e305])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k(df).where("query_id = 0").orderBy("rank").collect()]
    assert got == [(i, topk.LONG) for i in (1, 2, 3)]
    a, b = np.array([[3e9, 1024.0], [3e9, 1025.0]]), np.array([3e9 - 1, 3.0])
    assert list(topk.inner(a, b)) == [3 * 10**9 * (3 * 10**9 - 1) + 3072, 3 * 10**9 * (3 * 10**9 - 1) + 3075]


@pytest.mark.parametrize("spread", [1.0, 6.0])
def test_search_stops_before_it_has_seen_all_rows(spread):
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(4000, 4)) ** 3 * 1024 * spread)
    lists, ids = topk.lists_of(x), np.arange(4000)
    for n in range(0, 400, 40):
        best, scores, seen = topk.best_of(ids, x, lists, n, x[n], 10)
        want = sorted(((-int(s), i) for i, s in enumerate(x @ x[n]) if i != n))[:10]
        assert [(-int(s), int(i)) for i, s in zip(best, scores)] == want
        assert seen < 4000
