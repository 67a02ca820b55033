"""Classical scaling of all rows against dense eigenvectors."""

import numpy as np
import pytest

from hyperweave.operators import matrices as mx, scaling as sc


def table(spark, x, fold=None):
    rows = [(i, [float(c) for c in v], "x", int(fold[i]) if fold is not None else 0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>, grp string, fold int")


def test_coordinates_are_those_of_dense_scaling(spark):
    x = np.random.default_rng(3).normal(size=(90, 6)) * [5, 4, 3, 2, 1, 0.5] + 1000
    d = mx.pairwise(x, x)
    want, values = mx.classical_mds(d, 3)
    got = {r.id: r.coords for r in sc.coordinates(table(spark, x).repartition(7), "id", "v", 3).collect()}
    y = np.array([got[i] for i in range(len(x))])
    assert np.allclose(mx.pairwise(y, y), mx.pairwise(want, want), atol=1e-5)
    rows = sc.spectrum(table(spark, x).repartition(5), "id", "v", 4).orderBy("dim").collect()
    assert np.allclose([r.eigenvalue for r in rows], values[:4], rtol=1e-6)
    assert rows[3].first_ratio == pytest.approx(values[:4].sum() / np.abs(values).sum(), rel=1e-6)
    assert rows[3].second_ratio == pytest.approx((values[:4] ** 2).sum() / (values**2).sum(), rel=1e-6)


def test_few_dimensions_nulls_and_empty_tables(spark):
    line = np.outer(np.arange(20), [1.0, 2.0, 2.0])  # one dimension in three components
    df = table(spark, line).union(spark.createDataFrame([(None, [1.0, 1.0, 1.0], "y", 0), (99, None, "y", 0)], "id long, v array<double>, grp string, fold int"))
    got = {r.id: r.coords for r in sc.coordinates(df, "id", "v", 3).collect()}
    assert sorted(got) == list(range(20)) and all(len(c) == 1 for c in got.values())
    assert np.allclose([got[i][0] for i in range(20)], (np.arange(20) - 9.5) * 3)
    assert sc.coordinates(df.limit(0), "id", "v", 3).count() == 0 and sc.spectrum(df.limit(0), "id", "v", 3).count() == 0
    same = table(spark, np.ones((5, 3)))
    assert sc.spectrum(same, "id", "v", 3).count() == 0 and all(r.coords == [] for r in sc.coordinates(same, "id", "v", 3).collect())


def test_held_out_errors_against_loops(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 5)) * [4, 3, 1, 0.5, 0.2]
    fold = rng.integers(0, 4, 60)
    asked = [0, 7, 30, 31, 59]
    want = []
    for dims in (1, 2, 3):
        errors = []
        for f in range(4):
            train = np.flatnonzero(fold != f)
            _, own = sc.axes((x[train] - x[train].mean(0)).T @ (x[train] - x[train].mean(0)), dims)
            each = [(np.linalg.norm((x[p] - x[t]) @ own) - np.linalg.norm(x[p] - x[t])) ** 2 for p in asked if fold[p] == f for t in train]
            if each:
                errors.append(np.mean(each))
        want.append(np.sqrt(np.mean(errors)))
    queries = spark.createDataFrame([(i,) for i in asked], "id long")
    for bytes_of_block in (None, 200):
        if bytes_of_block:
            monkeypatch.setattr("hyperweave.operators.neighbours.BLOCK_BYTES", bytes_of_block)
        got = sc.held_out_errors(table(spark, x, fold), "id", "v", "fold", queries, 3).orderBy("dim").collect()
        assert np.allclose([r.error for r in got], want) and [r.dim for r in got] == [1, 2, 3]
        assert got[0].pairs == sum((fold != fold[p]).sum() for p in asked)
    assert sc.held_out_errors(table(spark, x, fold).limit(0), "id", "v", "fold", queries, 3).count() == 0


def test_negative_zeros_stay_as_in_sql(spark, tmp_path):
    """Coordinates just below zero: their text is the same as SQL's, not only their value."""
    import duckdb

    from hyperweave.plans import catalog

    near = np.eye(10) * 2.0**-17
    rows = np.concatenate([np.diag(3 - np.arange(10) / 8), near])
    rows = np.concatenate([rows, -rows])
    df = spark.createDataFrame([(k, [float(x) for x in r], 0) for k, r in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"file://{tmp_path}/embeddings.parquet")
    found = {r.id: [str(x) for x in r.coords] for r in catalog.queries()["landmark_scaling"](spark, f"file://{tmp_path}").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {i: [str(x) for x in c] for i, c in con.execute(catalog.oracle_sql()["landmark_scaling"]).fetchall()}
    below = [(at + k, k) for k in range(8) for at in (10, 30)]  # 2**-17 on its own axis, and as much below zero
    assert {want[i][k] for i, k in below} == {"0.0", "-0.0"}
    assert [found[i][k] for i, k in below] == [want[i][k] for i, k in below]
