"""Average linkage and weighted paths on tables against plain versions."""

import heapq
import random

import numpy as np
import pytest

from hyperweave.operators import linkage as lk, matrices as mx, paths as pt


def average_linkage(d: np.ndarray) -> tuple[list[tuple[int, int, float, int]], np.ndarray]:
    """(merges as (a, b, height, size), cophenetic distances) by averages between clusters."""
    n = len(d)
    work = d.astype(float).copy()
    np.fill_diagonal(work, np.inf)
    name, members, merges, far = list(range(n)), {i: [i] for i in range(n)}, [], np.zeros((n, n))
    live = list(range(n))
    for step in range(n - 1):
        sub = work[np.ix_(live, live)]
        i, j = divmod(int(sub.argmin()), len(live))
        a, b = sorted((live[i], live[j]))
        h = work[a, b]
        left, right = members[a], members[b]
        far[np.ix_(left, right)] = h
        far[np.ix_(right, left)] = h
        merges.append((*sorted((name[a], name[b])), float(h), len(left) + len(right)))
        mean = (len(left) * work[a] + len(right) * work[b]) / (len(left) + len(right))
        work[a], work[:, a] = mean, mean
        work[a, a] = np.inf
        members[a] = left + right
        name[a] = n + step
        live.remove(b)
    return merges, far


def clusters_of(merges: list[tuple[int, int, float, int]], n: int, k: int) -> np.ndarray:
    """Labels of the ``k`` clusters that a linkage leaves, numbered by their first points."""
    parent = list(range(2 * n))

    def top(v: int) -> int:
        while parent[v] != v:
            v = parent[v]
        return v

    for step, (a, b, _, _) in enumerate(merges[: max(0, n - k)]):
        parent[top(a)] = parent[top(b)] = n + step
    number: dict[int, int] = {}
    return np.array([number.setdefault(top(i), len(number)) for i in range(n)])


def test_plain_linkage():
    x = np.array([[0.0], [1.0], [10.0], [12.0], [30.0]])
    merges, far = average_linkage(mx.pairwise(x, x))
    assert [m[3] for m in merges] == [2, 2, 4, 5] and merges[0][2] == 1 and merges[1][2] == 2
    assert far[0, 3] == 10.5 and list(clusters_of(merges, 5, 2)) == [0, 0, 0, 0, 1] and list(clusters_of(merges, 5, 5)) == [0, 1, 2, 3, 4]


def test_linkage_of_several_groups_at_once(spark):
    groups = {g: np.random.default_rng(g).normal(size=(n, 2)) for g, n in ((1, 30), (2, 17), (3, 2))}
    dist = {g: mx.pairwise(x, x) for g, x in groups.items()}
    rows = [(g, i, j, float(d[i, j])) for g, d in dist.items() for i in range(len(d)) for j in range(i + 1, len(d))]
    merges, far = lk.average_linkage(spark.createDataFrame(rows, "grp int, i int, j int, d double"))
    merges, far = merges.cache(), far.collect()
    items = spark.createDataFrame([(g, i) for g, x in groups.items() for i in range(len(x))], "grp int, item int")
    flat = {k: lk.cut(merges, items, k).collect() for k in (1, 4)}
    corr = {r.grp: r for r in lk.cophenetic_correlation(spark.createDataFrame(far)).collect()}
    for g, d in dist.items():
        want, joined = average_linkage(d)
        got = sorted((r.height, r.size) for r in merges.where(f"grp = {g}").collect())
        assert np.allclose(got, sorted((h, n) for _, _, h, n in want)) and len(got) == len(d) - 1
        assert all(np.isclose(r.height, joined[r.i, r.j]) for r in far if r.grp == g)
        assert sum(r.grp == g for r in far) == len(d) * (len(d) - 1) // 2
        upper = np.triu_indices(len(d), 1)
        if len(d) > 2:
            assert corr[g].correlation == pytest.approx(np.corrcoef(d[upper], joined[upper])[0, 1])
        for k, rows in flat.items():
            own = {r.item: r.cluster for r in rows if r.grp == g}
            labels = clusters_of(want, len(d), k)
            assert all((own[i] == own[j]) == (labels[i] == labels[j]) for i in own for j in own)
            assert all(own[i] == min(j for j in own if own[j] == own[i]) for i in own)


def test_linkage_of_ties_and_of_nothing(spark):
    kind = "grp int, i int, j int, d double"
    merges, far = lk.average_linkage(spark.createDataFrame([(1, i, j, 1.0) for i in range(5) for j in range(i + 1, 5)], kind))
    assert [r.height for r in merges.collect()] == [1.0] * 4 and {r.height for r in far.collect()} == {1.0} and far.count() == 10
    merges, far = lk.average_linkage(spark.createDataFrame([], kind))
    assert merges.collect() == [] and far.collect() == []


def dijkstra(edges, source):
    near, heap, dist = {}, [(0, source)], {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    while heap:
        d, v = heapq.heappop(heap)
        if v not in dist:
            dist[v] = d
            for u, w in near.get(v, ()):
                heapq.heappush(heap, (d + w, u))
    return dist


def test_paths_equal_dijkstra(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(40), rng.randrange(40), rng.randint(1, 9)) for _ in range(70)] + [(50, 51, 1), (3, 3, 1)]
    df = spark.createDataFrame(edges, "a long, b long, w long")
    pairs = [(s, t) for s in (0, 1, 50, 77) for t in (0, 5, 9, 17, 30, 51, 77)]
    found = pt.paths(df, spark.createDataFrame(pairs, "source long, target long")).collect()
    assert sorted((r.source, r.target) for r in found) == sorted(pairs)
    cost = {}
    for a, b, w in edges:
        cost[a, b] = cost[b, a] = min(w, cost.get((a, b), w))
    for r in found:
        want = dijkstra(edges, r.source)
        assert r.dist == (want[r.target] if r.target in want else None)
        if r.dist is not None:
            assert (r.path[0], r.path[-1]) == (r.source, r.target) and sum(cost[s] for s in zip(r.path, r.path[1:])) == r.dist
    every = {(r.source, r.node): r.dist for r in pt.distances(df, spark.createDataFrame([(0,), (50,)], "source long")).collect()}
    assert every == {(s, v): d for s in (0, 50) for v, d in dijkstra(edges, s).items()}


def test_neighbours_are_raised_until_the_ends_are_joined(spark):
    at = [0.0, 1.0, 1.5, 10.0, 11.0, 11.5, 30.0]
    rows = [(i, j, abs(x - y)) for i, x in enumerate(at) for j, y in enumerate(at) if i != j]
    dist = spark.createDataFrame(rows, "i long, j long, d double")
    pairs = spark.createDataFrame([(0, 4)], "source long, target long")
    found, k = pt.joined_paths(dist, pairs, 1, 6)
    (r,) = found.collect()
    assert k == 3 and r.path[0] == 0 and r.path[-1] == 4 and len(r.path) > 2
    found, k = pt.joined_paths(dist, pairs, 1, 2)
    assert k == 2 and found.collect()[0].path is None


def test_known_distances_are_not_told_again(spark, monkeypatch):
    edges = spark.createDataFrame([(0, 1, 2), (1, 2, 2), (0, 2, 5), (3, 4, 1)], "a long, b long, w long")
    pairs = spark.createDataFrame([(0, 2), (0, 4), (3, 4)], "source long, target long")
    want = sorted(map(str, pt.paths(edges, pairs).collect()))
    dist = pt.distances(edges, pairs)
    monkeypatch.setattr(pt, "distances", None)
    assert sorted(map(str, pt.paths(edges, pairs, dist).collect())) == want
