"""Portraits and tables of results against brute force on small tables."""

import collections
import itertools
import math
import random

from pyspark.sql import functions as F

from hyperweave.operators import portraits, reports as rp


def brute_portrait(facts):
    """Counter of (m, n, l, k) by breadth-first search over facts that share constants."""
    facts = {e: set(vs) for e, vs in facts.items() if len(vs) > 1}
    dist = {}
    for e in facts:
        seen, front, l = {e: 0}, [e], 0
        while front:
            l += 1
            front = [f for f in facts if f not in seen and any(facts[f] & facts[g] for g in front)]
            seen.update((f, l) for f in front)
        dist[e] = seen
    longest, largest = max(max(d.values()) for d in dist.values()), max(map(len, facts.values()))
    out = collections.Counter()
    for e, d in dist.items():
        for n, l in itertools.product(range(2, largest + 1), range(longest + 1)):
            out[len(facts[e]), n, l, sum(1 for f, x in d.items() if x == l and len(facts[f]) == n)] += 1
    return out


def made(seed):
    rng = random.Random(seed)
    return {
        hg: {e: rng.sample(range(12), rng.choice([1, 2, 2, 3])) for e in range(rng.randint(2, 8))} | {99: [0, 1]}
        for hg in [0, 1, 2, 100, 101, 200]
    }


def test_portraits_and_divergence(spark):
    records = made(4)
    rows = [(hg, e, v) for hg, facts in records.items() for e, vs in facts.items() for v in vs]
    inc = spark.createDataFrame(rows, "hg long, e long, v long")
    found = portraits.portrait(inc)
    got = collections.defaultdict(collections.Counter)
    for r in found.collect():
        got[r.hg][r.m, r.n, r.l, r.k] += r.times
    want = {hg: brute_portrait(facts) for hg, facts in records.items()}
    assert dict(got) == want

    def jsd(a, b):
        p, q = ({c: n / sum(x.values()) for c, n in x.items()} for x in (a, b))
        mid = {c: (p.get(c, 0) + q.get(c, 0)) / 2 for c in p.keys() | q.keys()}
        return sum(x[c] * math.log2(x[c] / mid[c]) / 2 for x in (p, q) for c in x)

    pairs = {(r.i, r.j): r.divergence for r in portraits.portrait_divergence(found).collect()}
    assert set(pairs) == {(i, j) for i in (0, 100, 200) for j in records if i != j}
    assert all(abs(d - jsd(want[i], want[j])) < 1e-9 for (i, j), d in pairs.items())


def test_portrait_of_nothing(spark):
    none = spark.createDataFrame([], "hg long, e long, v long")
    assert portraits.portrait(none).count() == 0


def test_split_keeps_one_of_each_label_and_nulls(spark):
    rows = spark.createDataFrame([(k, "a" if k < 10 else "b" if k < 11 else None) for k in range(16)], "id long, label string")
    found = rp.split(rows, "id", "label", 0.8, 1).collect()
    assert collections.Counter((r.label, r.train) for r in found) == {("a", True): 8, ("a", False): 2, ("b", True): 1, (None, True): 4, (None, False): 1}


def test_subsample_is_bounded_and_even(spark):
    rows = spark.range(100).select("id", (F.col("id") % 3).alias("label"))
    found = rp.subsample(rows, "id", "label", 10, 1).collect()
    assert collections.Counter(r.label for r in found) == {0: 3, 1: 3, 2: 3}
    assert rp.subsample(rows, "id", "label", 100, 1).count() == 100
    assert rp.subsample(rows, "id", "id", 10, 1).count() == 10


def test_yields_of_a_cell_without_any(spark):
    runs = spark.createDataFrame([("x", True, 1.0), ("x", True, 3.0), ("y", False, 2.0)], "arm string, done boolean, cost double")
    found = {r.arm: (r.members, r.completed, r.share, r.median) for r in rp.yields(runs, ["arm"], "done", "cost").collect()}
    assert found == {"x": (2, 2, 1.0, 2.0), "y": (1, 0, 0.0, None)}


def test_frontier_takes_the_first_of_tied_cells(spark):
    cells = spark.createDataFrame([("a", 2, 0, 7), ("a", 2, 0, 5), ("a", 3, 1, 1), ("b", 1, 2, 1)], "arm string, m int, censored int, cell int")
    assert [(r.arm, r.m, r.cell) for r in rp.frontier(cells, ["arm"], "m", "censored", "cell").collect()] == [("a", 2, 5)]


def test_agreement_of_equal_partitions_is_one(spark):
    parts = spark.createDataFrame([(k, m, str(k % 3)) for k in range(12) for m in ("p", "q")], "item long, method string, class string")
    assert [(r.a, r.b, r.items, r.ari) for r in rp.agreement_of_partitions(parts).collect()] == [("p", "q", 12, 1.0)]
