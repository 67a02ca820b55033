"""Certificates and alignments against enumeration, and what the checks must refuse."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from hyperweave.functions.canonical import canonical_form, canonical_word
from hyperweave.operators import alignments as al

KIND = "rec long, facts array<array<string>>"


def records(spark, rows):
    return spark.createDataFrame([(k, sorted(sorted(f) for f in facts)) for k, facts in rows], KIND)


def cyclic(n, base):
    return [tuple(sorted((b + i) % n for b in base)) for i in range(n)]


FANO = [(0, 1, 2), (0, 3, 4), (0, 5, 6), (1, 3, 5), (1, 4, 6), (2, 3, 6), (2, 4, 5)]
DESIGNS = {"fano": (7, FANO), "a13": (13, cyclic(13, (0, 1, 4))), "b13": (13, cyclic(13, (0, 1, 6))), "pg23": (13, cyclic(13, (0, 1, 3, 9))), "pg24": (21, cyclic(21, (3, 6, 7, 12, 14)))}


@pytest.mark.parametrize("name", DESIGNS)
def test_designs_have_a_word_within_few_leaves(name):
    n, blocks = DESIGNS[name]
    order = list(range(n))
    random.Random(4).shuffle(order)
    moved = [(0, tuple(sorted(order[v] for v in b))) for b in blocks]
    word = canonical_word([0] * n, [(0, b) for b in blocks], max_leaves=400)
    assert word and word == canonical_word([0] * n, moved[::-1], max_leaves=400)
    if name == "a13":
        assert word != canonical_word([0] * 13, [(0, b) for b in DESIGNS["b13"][1]])


def test_words_are_the_same_for_isomorphic_records_only():
    rng = random.Random(9)
    for _ in range(150):
        n = rng.randint(2, 5)
        pick = lambda: [(rng.randint(0, 1), tuple(sorted(rng.sample(range(n), rng.randint(1, min(3, n)))))) for _ in range(rng.randint(1, 5))]
        types, one, two = [rng.randint(0, 1) for _ in range(n)], pick(), pick()
        alike = any(
            all(types[p[v]] == types[v] for v in range(n)) and {(k, tuple(sorted(p[v] for v in m))) for k, m in one} == {*two}
            for p in itertools.permutations(range(n))
        )
        (a, ranks), (b, _) = canonical_form(types, one), canonical_form(types, two)
        assert (a == b) == alike and sorted(ranks) == list(range(n))


def test_every_member_of_a_class_has_a_verified_map(spark):
    rng, rows = random.Random(2), []
    for k, (n, blocks) in enumerate(DESIGNS.values()):
        for copy in range(3):
            names = [f"{chr(97 + v)}{copy}" for v in range(n)]
            rng.shuffle(names)
            rows.append((10 * k + copy, [[names[v] for v in b] for b in blocks]))
    df = records(spark, rows)
    found = al.verified(al.certificates(al.forms(df)), df).collect()
    assert {r.rec: r["first"] for r in found} == {k: k - k % 10 for k, _ in rows} and all(r.verified for r in found)


def test_wrong_maps_are_refused(spark):
    df = records(spark, [(1, [["a", "b"], ["b", "c"]]), (2, [["x", "y"], ["y", "z"]]), (3, [["x", "y"], ["y", "z"], ["x", "z"]])])
    maps = [(2, 1, {"x": "a", "y": "b", "z": "c"}), (2, 1, {"x": "b", "y": "a", "z": "c"}), (2, 1, {"x": "a", "y": "b"}), (2, 1, {"x": "a", "y": "b", "z": "a"})]
    maps += [(3, 1, {"x": "a", "y": "b", "z": "c"}), (2, 3, {"x": "x", "y": "y", "z": "z"}), (2, 1, {"x": "c", "y": "b", "z": "a", "q": "q"})]
    w = spark.createDataFrame([(k, r, f, list(m.items())) for k, (r, f, m) in enumerate(maps)], "k int, rec long, first long, map array<struct<v:string,w:string>>")
    assert [r.verified for r in al.verified(w, df).orderBy("k").collect()] == [True, False, False, False, False, False, False]


def test_censored_records_stand_alone(spark):
    df = al.forms(records(spark, [(1, [["a", "b"], ["c", "d"]]), (2, [["e", "f"], ["g", "h"]])]), max_leaves=0)
    assert [(r.rec, r["first"]) for r in al.certificates(df).orderBy("rec").collect()] == [(1, 1), (2, 2)]


def isomorphic(one, two):
    a, b = (sorted({v for f in x for v in f}) for x in (one, two))
    want = {frozenset(f) for f in one}
    return len(a) == len(b) and any({frozenset(p[b.index(v)] for v in f) for f in two} == want for p in itertools.permutations(a))


@pytest.mark.parametrize("most,side", [(0, None), (2, None), (2, 1)])
def test_alignments_equal_enumeration(spark, most, side):
    rng = random.Random(most)
    rows = [(k, {frozenset(rng.sample("abcde", rng.randint(1, 3))) for _ in range(rng.randint(1, 4))}) for k in range(14)]
    facts = {k: sorted(sorted(f) for f in own) for k, own in rows}
    df = records(spark, rows)
    pairs = spark.createDataFrame([(a, b) for a in range(14) for b in range(a + 1, 14)], "a long, b long")
    found = al.alignments(pairs, df, most, side).withColumn("fits", al.carried("left_b", "map") == F.array_sort("left_a")).collect()
    cap = most if side is None else side
    cuts = lambda own: [(d, [f for f in own if f not in d]) for n in range(cap + 1) for d in map(list, itertools.combinations(own, n))]
    want = sorted((a, b, x, y) for a in range(14) for b in range(a + 1, 14) for x, left in cuts(facts[a]) for y, right in cuts(facts[b]) if len(x) + len(y) <= most and isomorphic(left, right))
    assert sorted((r.a, r.b, r.deleted_a, r.deleted_b) for r in found) == want
    assert all(r.fits for r in found)
    bounds = {(r.a, r.b): r for r in al.compatible(pairs, df, most).collect()}
    for a, b, x, y in want:
        assert bounds[a, b].possible and bounds[a, b].floor <= len(x) + len(y)
