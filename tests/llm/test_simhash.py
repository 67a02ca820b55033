import random

import pytest
import xxhash

from hyperweave.llm import simhash as sh
from hyperweave.llm.common import components

from .helpers import empty, odd


def plain(text):
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \t", "One", "one TWO", "a b c", "Éa b É c d a b c", "x y z " * 50])
def test_fingerprint(text):
    assert sh.simhash(text) == plain(text)


def test_fingerprint_of_long_text():
    text = " ".join(str(i % 977) for i in range(3 * sh.BLOCK))
    assert sh.simhash(text) == plain(text)


def test_links_equal_brute_force(spark):
    r = random.Random(3)
    fps = set()
    for _ in range(60):
        base = r.getrandbits(64)
        fps.add(base)
        for _ in range(4):
            near = base
            for b in r.sample(range(64), r.randint(1, 4)):
                near ^= 1 << b
            fps.add(near)
    fps = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)] + [0, 1, 3, 7]
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame(list(zip(fps, range(len(fps)))), "fp long, rep long")
    place = {f: k for k, f in enumerate(fps)}
    got = [tuple(sorted((place[x.a], place[x.b]))) for x in sh.link_fingerprints(df).collect()]
    bits = lambda i, j: ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count()
    want = {(i, j) for i in range(len(fps)) for j in range(i) if bits(i, j) <= 2}
    assert len(got) == len(set(got)) and set(got) == {tuple(sorted(p)) for p in want}


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 150)] + [(7, 7)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {k: 100 for k in range(100, 150)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_hubs(spark):
    """Nodes with a large share of all links, joined to each other through chains."""
    r = random.Random(2)
    links = [(5000, k) for k in range(3000)] + [(6000, k) for k in range(3000, 4500)] + [(k, k + 1) for k in range(7000, 7040)] + [(7020, 2999), (6000, 7040)]
    links += [(r.randrange(8000, 9000), r.randrange(8000, 9000)) for _ in range(700)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    got = {x.node: x.comp for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: top(k) for a, b in links if a != b for k in (a, b)}


def test_rows_that_share_an_id_are_separate_documents(spark):
    one, two = "alpha beta gamma delta epsilon zeta", "no word of it is the same as in the other one"
    rows = [(5, one), (5, two), (3, two), (None, one), (None, "yet another text, without an id at all"), (9, one), (9, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in sh.keep_first(docs).collect())
    assert got == sorted([(5, one), (3, two), (-1, rows[4][1])])
    found = {(r.doc_id, r.component_id) for r in sh.simhash_components(docs).collect()}
    assert found == {(5, 5), (5, 3), (3, 3), (None, 5), (None, None), (9, 5)}


def test_odd_rows(spark):
    got = sorted((r.doc_id or -1, r.component_id) for r in sh.simhash_components(odd(spark)).collect())
    assert len(got) == 8 and (6, 5) in got and (2, 1) in got and (3, 1) in got
    kept = sh.keep_first(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4, 5]


def test_empty(spark):
    assert sh.simhash_components(empty(spark)).count() == 0 and sh.keep_first(empty(spark)).count() == 0
