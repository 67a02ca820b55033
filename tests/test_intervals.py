"""Intervals and paired comparisons against plain versions."""

import hashlib
import itertools
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperweave.operators import intervals as iv


def test_normal_functions(spark):
    xs = [-6.0, -2.5, -1.0, -0.01, 0.0, 0.3, 1.96, 5.0]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", iv.normal_cdf(F.col("x")).alias("p")).collect():
        assert r.p == pytest.approx(NormalDist().cdf(r.x), abs=2e-7)
    ps = [1e-6, 0.01, 0.02425, 0.3, 0.5, 0.7, 0.98, 1 - 1e-6]
    for r in spark.createDataFrame([(p,) for p in ps], "p double").select("p", iv.normal_quantile(F.col("p")).alias("x")).collect():
        assert r.x == pytest.approx(NormalDist().inv_cdf(r.p), abs=1e-7)


def plain(rows, draws, seed):
    """(mean, low, high, method) of rows (unit, value)."""
    units = sorted({u for u, _ in rows})
    own = {u: [v for w, v in rows if w == u] for u in units}
    mean = np.mean([v for _, v in rows])
    ms = []
    for d in range(1, draws + 1):
        us = {u: int(hashlib.md5(f"{u}|{d}|{seed}".encode()).hexdigest()[:8], 16) / 2**32 for u in units}
        w = {u: sum(us[u] >= c for c in iv.POISSON) for u in units}
        n = sum(w[u] * len(own[u]) for u in units)
        if n:
            ms.append(sum(w[u] * sum(own[u]) for u in units) / n)
    jack = [np.mean([v for w, v in rows if w != u]) for u in units if len(own[u]) < len(rows)]
    apart = np.mean(jack) - np.array(jack) if jack else np.zeros(0)
    below = np.mean(np.array(ms) < mean)
    if min(ms) == max(ms):
        return mean, mean, mean, "constant"
    shares, method = (0.025, 0.975), "percentile"
    if 0 < below < 1 and (apart**2).sum() > 0:
        a, z0, nd = (apart**3).sum() / (6 * (apart**2).sum() ** 1.5), NormalDist().inv_cdf(below), NormalDist()
        shares, method = tuple(nd.cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) for z in (-iv.Z, iv.Z)), "bca"
    return mean, *np.quantile(ms, shares), method


def test_intervals_equal_a_plain_version(spark):
    r = np.random.default_rng(1)
    groups = {
        "skewed": [(k, float(v)) for k, v in enumerate(r.exponential(size=40))],
        "clusters": [(k % 7, float(v)) for k, v in enumerate(r.normal(size=50) + np.arange(50) % 7)],
        "flat": [(k, 2.0) for k in range(10)],
        "single": [(1, 3.0)],
    }
    rows = [(g, u, v) for g, own in groups.items() for u, v in own] + [("skewed", 99, None)]
    found = {x.g: x for x in iv.bca_interval(spark.createDataFrame(rows, "g string, unit long, v double"), "g", "v", "unit", 150, 5).collect()}
    for g, own in groups.items():
        mean, low, high, method = plain(own, 150, 5)
        x = found[g]
        assert (x.mean, x.low, x.high) == (pytest.approx(mean), pytest.approx(low, abs=1e-5), pytest.approx(high, abs=1e-5)) and x.method == method
        assert x.units == len({u for u, _ in own}) and x.low <= x.mean <= x.high


def chance(gaps):
    """(plus, minus, two-sided chance) over all signs of the ranks."""
    gaps = [g for g in gaps if g]
    sizes = sorted(abs(g) for g in gaps)
    rank = {s: sizes.index(s) + (sizes.count(s) + 1) / 2 for s in sizes}
    plus = sum(rank[abs(g)] for g in gaps if g > 0)
    sums = [sum(rank[abs(g)] for g, s in zip(gaps, signs) if s) for signs in itertools.product((0, 1), repeat=len(gaps))]
    low, high = np.mean([s <= plus for s in sums]), np.mean([s >= plus for s in sums])
    return plus, sum(rank[abs(g)] for g in gaps) - plus, min(1.0, 2 * min(low, high))


def test_exact_chances_equal_enumeration_and_families_are_corrected(spark):
    r = np.random.default_rng(2)
    tests = {("f", "a"): [1, 2, 3, 4, 5, 6, 7, 8], ("f", "b"): [int(x) for x in r.integers(-3, 4, 10)], ("f", "c"): [-1, 2, -3, 4, 0, 0], ("g", "a"): [0, 0], ("g", "b"): [-5]}
    rows = [(f, n, float(x)) for (f, n), own in tests.items() for x in own]
    found = {(x.family, x.name): x for x in iv.paired_family(spark.createDataFrame(rows, "family string, name string, gap double")).collect()}
    for key, own in tests.items():
        plus, minus, p = chance(own)
        x = found[key]
        assert (x.n, x.ties, x.plus, x.minus, x.p) == (sum(g != 0 for g in own), own.count(0), plus, minus, pytest.approx(p))
    for family in "fg":
        own = sorted((x.p, x.name, x.adjusted) for x in found.values() if x.family == family)
        steps = [min(1.0, (len(own) - k) * p) for k, (p, _, _) in enumerate(own)]
        assert [a for _, _, a in own] == pytest.approx(list(itertools.accumulate(steps, max)))


def test_many_pairs_take_the_normal_approximation(spark):
    r = np.random.default_rng(3)
    gaps = [round(float(x), 1) for x in r.normal(size=120) + 0.2]
    (x,) = iv.paired_family(spark.createDataFrame([("f", "a", g) for g in gaps], "family string, name string, gap double")).collect()
    own = [g for g in gaps if g]
    n, sizes = len(own), [abs(g) for g in own]
    tied = sum(c**3 - c for c in (sizes.count(s) for s in set(sizes)))
    z = abs(x.plus - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - tied / 48)
    assert not x.exact and x.n == n and x.p == pytest.approx(2 * NormalDist().cdf(-z), abs=1e-6)
