"""Medoids, outliers and edit distances against plain versions."""

import itertools
import random

import numpy as np

from hyperweave.functions import editdistance as ed
from hyperweave.operators import matrices as mx


def points(n=30, dims=3, seed=1):
    return np.random.default_rng(seed).normal(size=(n, dims))


def test_classical_scaling_keeps_euclidean_distances():
    x = points()
    d = mx.pairwise(x, x)
    y, values = mx.classical_mds(d, 3)
    assert np.allclose(mx.pairwise(y, y), d, atol=1e-6) and mx.negative_mass(values) < 1e-9
    assert mx.smacof(d, 2)[1] <= mx.stress(d, mx.pairwise(*[mx.classical_mds(d, 2)[0]] * 2)) + 1e-9


def test_k_medoids_against_enumeration():
    d = mx.pairwise(points(12), points(12))
    d = (d + d.T) / 2
    best = min(d[list(c)].min(axis=0).sum() for c in itertools.combinations(range(12), 3))
    assert mx.k_medoids(d, 3)[1] <= 1.1 * best


def test_outlier_has_the_largest_factor(spark):
    x = np.vstack([points(60, 2), [[30.0, 30.0]]])
    assert mx.lof(mx.pairwise(x, x), 5).argmax() == 60
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")
    got = {r.id: r for r in mx.placed(df, "id", "v", 3, 5).collect()}
    want = mx.lof(mx.pairwise(x, x), 5)
    assert len(got) == 61 and np.allclose([got[i].lof for i in range(61)], want, rtol=1e-6)


def test_assignment_against_enumeration():
    r = random.Random(2)
    for _ in range(60):
        n = r.randint(1, 5)
        c = [[r.randint(0, 9) for _ in range(n)] for _ in range(n)]
        got = ed.assignment(c)
        assert sorted(got) == list(range(n))
        assert sum(c[i][j] for i, j in enumerate(got)) == min(sum(c[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))


def test_edit_distance_against_all_maps():
    r = random.Random(7)

    def graph():
        n = r.randint(1, 4)
        return [r.randint(0, 1) for _ in range(n)], list({(r.randint(0, 1), tuple(sorted(r.sample(range(n), r.randint(1, n))))) for _ in range(r.randint(0, 3))})

    for _ in range(60):
        a, b = graph(), graph()
        maps = [m for m in itertools.product([*range(len(b[0])), None], repeat=len(a[0])) if len({w for w in m if w is not None}) == sum(w is not None for w in m)]
        best = min(ed.mapped_cost(a, b, list(m)) for m in maps)
        assert ed.exact(a, b) == best and ed.bipartite(a, b) >= best
        assert ed.exact(a, a) == 0 and ed.exact(a, b) == ed.exact(b, a)
    assert ed.exact(([0] * 6, []), ([1] * 6, [(0, (0, 1, 2))]), max_steps=2) is None


def test_edit_distance_table(spark):
    kind = "a long, b long, types_a array<int>, facts_a array<struct<pred:int,members:array<int>>>, types_b array<int>, facts_b array<struct<pred:int,members:array<int>>>"
    rows = [(1, 2, [0, 0], [(0, [0, 1])], [0, 0, 0], [(0, [0, 1, 2])]), (1, 3, [], [], [], [])]
    got = {r.b: (r.exact, r.censored) for r in ed.edit_distances(spark.createDataFrame(rows, kind)).collect()}
    assert got == {2: (2.0, False), 3: (0.0, False)}


def test_medoids_and_outliers_take_all_rows(spark, monkeypatch):
    monkeypatch.setattr(mx, "BLOCK_ROWS", 300, raising=False)
    x = np.vstack([points(640, 3), points(60, 3, 2) * 0.01 + 8, [[9.0, 9.0, 9.0]]])  # more rows than landmarks
    x[100:130] = x[100]  # copies
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")
    got = {r.id: r for r in mx.placed(df.repartition(3), "id", "v", 4, 10).collect()}
    assert len(got) == len(x) and np.allclose([got[i].lof for i in range(len(x))], mx.lof(d, 10), rtol=1e-6)
    chosen, cost = mx.k_medoids(d, 4)
    assert np.isclose(sum(r.distance for r in got.values()), cost, rtol=1e-6) and {r.medoid for r in got.values()} == set(chosen.tolist())
