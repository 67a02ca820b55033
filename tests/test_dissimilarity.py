"""Spectra of tables of dissimilarities against dense eigenvalues."""

import hashlib
import itertools

import numpy as np

from hyperweave.operators import dissimilarity as ds


def digest(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def dense(d):
    centre = np.eye(len(d)) - 1 / len(d)
    values = np.linalg.eigvalsh(-0.5 * centre @ (d * d) @ centre)
    return np.delete(values, np.abs(values).argmin())[::-1]  # without the constant vector's


def made(n, seed, power=1.0):
    x = np.random.default_rng(seed).normal(size=(n, 3)) * [3, 2, 1]
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) ** power


def table(spark, groups):
    rows = [(g, i, j, float(d[i, j])) for g, d in groups.items() for i, j in itertools.combinations(range(len(d)), 2)]
    return spark.createDataFrame(rows, "grp string, i int, j int, d double")


def test_whole_spectra_and_ends_of_long_ones(spark):
    groups = {"a": made(9, 1, 2.0), "b": made(13, 2, 0.5), "c|1": made(2, 3), "d": made(80, 4, 1.5)}
    df = table(spark, groups)
    df = df.union(spark.createDataFrame([(None, 1, 2, 1.0), ("a", None, 2, 1.0), ("a", 1, 2, None)], df.schema))
    found = {}
    for r in ds.spectra(df, 4, 4).collect():
        found.setdefault(r.grp, []).append((r.rank, r.value, r.whole))
    for g in ("a", "b", "c|1"):
        assert np.allclose([v for _, v, _ in sorted(found[g])], dense(groups[g]), atol=1e-7) and all(w for *_, w in found[g])
    got, want = [v for _, v, _ in sorted(found["d"])], dense(groups["d"])
    assert len(got) == 16 and np.allclose(got[:3], want[:3], rtol=1e-4) and np.isclose(got[-1], want[-1], rtol=1e-2) and not any(w for *_, w in found["d"])
    assert ds.spectra(df.limit(0), 2, 2).count() == 0


def test_dimensions_beyond_chance(spark):
    groups = {"x": made(9, 5), "y": np.ones((9, 9)) - np.eye(9) + made(9, 6, 2.0) * 0.2, "z": np.zeros((4, 4))}
    got = {r.grp: r for r in ds.dimensions(table(spark, groups), 6, 0.9, 4, 2, seed=3).collect()}
    for g in ("x", "y"):
        d, pairs = groups[g], list(itertools.combinations(range(9), 2))
        own, null = dense(d), []
        for draw in range(1, 7):
            m = np.zeros((9, 9))
            for (a, b), (i, j) in zip(pairs, sorted(pairs, key=lambda p: (digest(*p, draw, 3), p))):
                m[a, b] = m[b, a] = d[i, j]
            null.append(dense(m))
        assert got[g].dimensions == int(((own > 1e-9 * own.max()) & (own > np.percentile(null, 90, axis=0))).sum()) and got[g].found == 8 and got[g].whole
        assert np.isclose(got[g].negative, -own[own < 0].sum() / np.abs(own).sum(), atol=1e-8)
    assert got["z"].dimensions == 0
