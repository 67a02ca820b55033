"""Corruptions against what they promise, isomorphism by trying all orders."""

import itertools
import random
from collections import Counter

import pytest

from hyperweave.operators import corruptions as co


def made(n_records=40, seed=4):
    rng = random.Random(seed)
    out = {}
    for hg in range(n_records):
        n = rng.randrange(3, 7)
        facts = {(rng.choice("ab"), tuple(sorted(rng.sample(range(n), rng.randrange(2, min(n, 4) + 1))))) for _ in range(rng.randrange(1, 8))}
        out[hg] = dict(enumerate(sorted(facts)))
    out[100] = {0: ("a", (0,))}
    out[101] = {0: ("a", (0, 1))}
    return out


RECORDS = made()


@pytest.fixture(scope="module")
def inc(spark):
    rows = [(hg, e, v, p) for hg, facts in RECORDS.items() for e, (p, m) in facts.items() for v in m]
    more = [(None, 1, 1, "a"), (1, None, 1, "a"), (1, 1, None, "a")]
    return spark.createDataFrame(rows * 2 + more, "hg long, e int, v long, pred string").repartition(3).cache()


def read(df):
    out: dict = {}
    for r in df.collect():
        p, m = out.setdefault(r.hg, {}).setdefault(r.e, (r.pred, set()))
        assert p == r.pred and r.v not in m
        m.add(r.v)
    return {hg: {e: (p, tuple(sorted(m))) for e, (p, m) in facts.items()} for hg, facts in out.items()}


def isomorphic(a, b):
    """Without labels, as sets of members."""
    fa, fb = ({m for _, m in x.values()} for x in (a, b))
    va, vb = (sorted({v for m in f for v in m}) for f in (fa, fb))
    if len(va) != len(vb) or sorted(map(len, fa)) != sorted(map(len, fb)):
        return False
    return any({tuple(sorted(to[v] for v in m)) for m in fa} == fb for order in itertools.permutations(vb) for to in [dict(zip(va, order))])


def shape(facts):
    degrees = Counter(v for _, m in facts.values() for v in m)
    return degrees, Counter((p, len(m)) for p, m in facts.values())


def test_spurious_facts(inc):
    got = read(co.spurious_facts(inc, 2, 5, attempts=60))
    for hg, facts in got.items():
        old = RECORDS[hg]
        assert {e: facts[e] for e in old} == old and sorted(set(facts) - set(old)) == [len(old), len(old) + 1]
        assert len(set(facts.values())) == len(old) + 2
        assert {v for _, m in facts.values() for v in m} == {v for _, m in old.values() for v in m}
    assert len(got) > 30 and 100 not in got and 101 not in got


def test_missing_facts(inc):
    got = read(co.missing_facts(inc, 2, 5))
    assert got.keys() == {hg for hg, f in RECORDS.items() if len(f) > 2}
    assert all(len(f) == len(RECORDS[hg]) - 2 and f.items() <= RECORDS[hg].items() for hg, f in got.items())


def test_wrong_arguments(inc):
    one = read(co.wrong_arguments(inc, 1, 5, attempts=40))
    for hg, facts in one.items():
        (e,) = [e for e in facts if facts[e] != RECORDS[hg][e]]
        (p, m), (q, old) = facts[e], RECORDS[hg][e]
        assert p == q and len(m) == len(old) and len(set(m) & set(old)) == len(m) - 1
        assert len(set(facts.values())) == len(facts) and not isomorphic(facts, RECORDS[hg])
    two = read(co.wrong_arguments(inc, 2, 5, attempts=40))
    assert len(one) > 10 and len(two) > 10 and all(not isomorphic(f, RECORDS[hg]) for hg, f in two.items())


def test_twins(inc):
    df = co.iso_twins(inc, 5, attempts=40, most_swaps=4).cache()
    got = read(df)
    for hg, facts in got.items():
        assert shape(facts) == shape(RECORDS[hg]) and len(set(facts.values())) == len(facts)
        assert not isomorphic(facts, RECORDS[hg])
    assert got and {r.swaps for r in df.select("swaps").distinct().collect()} <= {1, 2, 3, 4}


def test_empty_collections(inc):
    none = inc.limit(0)
    assert co.spurious_facts(none, 1, 1).count() == co.missing_facts(none, 1, 1).count() == 0
    assert co.wrong_arguments(none, 1, 1).count() == co.iso_twins(none, 1).count() == 0
