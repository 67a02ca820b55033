"""Programs, reach and consensus against plain versions."""

import itertools
import random

import pytest

from hyperweave.functions import programs as pg
from hyperweave.functions.canonical import canonical_word
from hyperweave.operators import language


def key(types, facts):
    return len(types), canonical_word(list(types), list(facts))


def test_tokens():
    text = "V[0;1;2;0,1];P[1];N[2];C[1;2];W;V[0;2;0;]"
    tokens = pg.parse(text)
    assert pg.serialize(tokens) == text and pg.parse("") == []
    assert pg.valid(tokens, 2, 2, 2) and not pg.valid(tokens, 1, 2, 2) and not pg.valid(tokens, 2, 1, 2)
    assert sorted([pg.parse("P[1];P[1]"), pg.parse("C[0;1]"), pg.parse("N[1]")], key=pg.shortlex)[0] == [("N", 1)]
    for bad in ("X", "V[0;1;2;0]", "P[]", "C[0]", ";"):
        with pytest.raises(ValueError):
            pg.parse(bad)


def test_machine():
    types, facts = pg.run("V[0;1;2;5,6];P[1];V[1;1;1;7];P[2];P[2];C[0;2];C[0;2]", 2, 4)
    assert types == [4, 5, 6, 7] and facts == [(0, (0, 1, 2)), (1, (1, 3)), (0, (1, 3))]
    assert len(pg.trace("W;W", 2)) == 3


def test_programs_round_trip():
    r = random.Random(9)
    for _ in range(200):
        n = r.randint(1, 7)
        types = [r.randint(0, 1) for _ in range(n)]
        facts = list({(r.randint(0, 1), tuple(sorted(r.sample(range(n), r.randint(1, min(n, 4)))))) for _ in range(r.randint(0, 6))})
        text = pg.encode(types, facts)
        reached = {0}
        while more := {v for _, m in facts if reached & set(m) for v in m} - reached:
            reached |= more
        if len(reached) < n:
            assert text is None
            continue
        k = max([2, *(len(m) for _, m in facts)])
        assert key(*pg.run(text, k, types[0])) == key(types, facts)
        assert pg.valid(pg.parse(text), k, 2, 2)


def words_left(facts, most):
    out = {}
    for n in range(most + 1):
        for drop in itertools.combinations(range(len(facts)), n):
            left = [f for i, f in enumerate(facts) if i not in drop]
            names = {}
            own = [(0, tuple(sorted(names.setdefault(v, len(names)) for v in f))) for f in left]
            out.setdefault(canonical_word([0] * len(names), own), n)
    return out


def test_reach_and_consensus(spark):
    r = random.Random(3)
    pick = lambda: [list(f) for f in {tuple(sorted(r.sample("abcd", r.randint(1, 3)))) for _ in range(r.randint(1, 4))}]
    recs = {k: pick() for k in range(14)}
    df = spark.createDataFrame([(k, sorted(f)) for k, f in recs.items()], "rec long, facts array<array<string>>")
    pairs = spark.createDataFrame([(a, b) for a in recs for b in recs if a < b], "a long, b long")
    left = {k: words_left(f, 2) for k, f in recs.items()}

    def plain(a, b):
        found = [left[a][w] + left[b][w] for w in left[a] if w in left[b] and left[a][w] + left[b][w] <= 2]
        return min(found, default=None)

    got = {(x.a, x.b): x.reach for x in language.reach(language.remainders(df, 2), pairs, 2).collect()}
    assert got == {(a, b): plain(a, b) for a in recs for b in recs if a < b}
    members = spark.createDataFrame([(k % 2, k) for k in recs], "grp int, rec long")
    found = {x.grp: (x.coverage, x.total) for x in language.consensus(members, language.remainders(df, 2), 2).collect()}
    for g in (0, 1):
        own = [k for k in recs if k % 2 == g]
        scores = []
        for a in own:
            rs = [plain(a, b) for b in own]
            scores.append((-sum(x is not None for x in rs), sum(3 if x is None else x for x in rs)))
        best = min(scores)
        assert found[g] == (-best[0], best[1])
