"""Operators on small records with known answers."""

import itertools
import random

import pytest

from hyperweave.functions.canonical import canonical_word
from hyperweave.functions.state import running
from hyperweave.operators import hypergraph as hg, records, words

FANO = [(0, 1, 2), (0, 3, 4), (0, 5, 6), (1, 3, 5), (1, 4, 6), (2, 3, 6), (2, 4, 5)]


def incidence(spark, edges, name=0):
    rows = [(name, e, v) for e, members in enumerate(edges) for v in members]
    return spark.createDataFrame(rows, "hg long, e int, v int")


def test_fano_degrees_and_primal_degrees(spark):
    inc = incidence(spark, FANO)
    assert {r.degree for r in hg.degree(inc).collect()} == {3}
    assert {(r.x1, r.x2) for r in hg.xi(inc, 2).collect()} == {(6, 0)}
    assert {r.x1 for r in hg.eta(inc, hg.xi(inc, 2)).collect()} == {18}


def test_components_of_two_parts(spark):
    inc = incidence(spark, [(0, 1), (1, 2), (2, 3), (5, 6), (9,)])
    got = {r.v: r.comp for r in hg.components(inc).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 5: 5, 6: 5, 9: 9}


def test_long_path_components(spark):
    inc = incidence(spark, [(i, i + 1) for i in range(40)])
    assert {r.comp for r in hg.components(inc).collect()} == {0}


def test_refinement_ignores_names(spark):
    mapped = [tuple((5 * v + 3) % 7 for v in e) for e in FANO[:5]]
    both = incidence(spark, FANO[:5], 1).union(incidence(spark, mapped, 2))
    found = hg.refine(both, 2).groupBy("hg", "colour").count().collect()
    profile = lambda k: sorted((r.colour, r["count"]) for r in found if r.hg == k)
    assert profile(1) == profile(2)


def test_words_round_trip(spark):
    edges = [(3, 8), (8, 9, 12), (3, 12)]
    found = words.decode(words.encode(incidence(spark, edges))).collect()[0]
    assert found.n == 4 and found.types == [0, 0, 0, 0]
    assert [tuple(f.members) for f in found.facts] == [(0, 1), (0, 3), (1, 2, 3)]


@pytest.mark.parametrize(
    "word, n, types, facts",
    [
        ("T1 F0(0,2) T2 F0(2,0)", 3, [1, 2, 0], [(0, (0, 2))]),
        ("T0 T0", 2, [0, 0], []),
        ("F3(1)", 2, [0, 0], [(3, (1,))]),
    ],
)
def test_decoder_is_total(spark, word, n, types, facts):
    r = words.decode(spark.createDataFrame([(1, word)], "hg int, word string")).collect()[0]
    assert (r.n, r.types, [(f.pred, tuple(f.members)) for f in r.facts]) == (n, types, facts)


def test_string_ball(spark):
    got = words.string_ball(spark.createDataFrame([("ab",)], "word string"), ["a", "b"], 2).collect()

    def edits(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    want = {"".join(w): edits("ab", w) for n in range(5) for w in itertools.product("ab", repeat=n) if edits("ab", w) <= 2}
    assert {r.near: r.dist for r in got} == want


def test_canonical_word_is_a_complete_invariant():
    def key(n, facts):
        return min(tuple(sorted((p, tuple(sorted(s[v] for v in m))) for p, m in facts)) for s in itertools.permutations(range(n)))

    r = random.Random(4)
    seen: dict[str, tuple] = {}
    for _ in range(150):
        n = r.randint(2, 5)
        facts = list({(r.randint(0, 1), tuple(sorted(r.sample(range(n), r.randint(1, n))))) for _ in range(r.randint(1, 4))})
        s = r.sample(range(n), n)
        moved = [(p, tuple(sorted(s[v] for v in m))) for p, m in facts]
        assert canonical_word([0] * n, facts) == canonical_word([0] * n, moved)
        word, own = f"{n} {canonical_word([0] * n, facts)}", (n, key(n, facts))
        assert seen.setdefault(word, own) == own
    assert len(set(seen.values())) == len(seen)


def test_alike_constants_need_one_branch():
    assert canonical_word([0] * 12, [(0, tuple(range(12)))], max_leaves=1) == " ".join(["T0"] * 12 + ["F0(0,1,2,3,4,5,6,7,8,9,10,11)"])


def test_canonical_word_gives_up_beyond_its_bound():
    cycle = [(0, tuple(sorted((k, (k + 1) % 7)))) for k in range(7)]
    assert canonical_word([0] * 7, cycle, max_leaves=5) is None and canonical_word([0] * 7, cycle)


def test_nearest_rank_matches_sorting(spark):
    r = random.Random(2)
    values = [r.randint(0, 30) for _ in range(101)]
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {x.p: x.v for x in records.nearest_rank(spark.createDataFrame([(v,) for v in values], "v int"), "v", shares).collect()}
    assert got == {p: sorted(values)[round(p * 100)] for p in shares}


def test_running_totals_over_ranges(spark):
    rows = [(i, i % 7) for i in range(500)]
    random.Random(1).shuffle(rows)
    got = {r.k: r.total for r in running(spark.createDataFrame(rows, "k int, n int").repartition(9), ["k"], {"total": "n"}).collect()}
    assert got == dict(zip(range(500), itertools.accumulate(i % 7 for i in range(500))))


def test_empty_tables(spark):
    inc = spark.createDataFrame([], "hg long, e int, v int")
    assert hg.components(inc).count() == 0 and hg.xi(inc, 2).count() == 0 and words.encode(inc).count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_equals_batch_over_a_folder_of_part_files(spark, tmp_path, parts):
    import datetime

    from hyperweave.streaming.windows import run_stream, windowed_counts

    rows = [(k % 3, datetime.datetime(2024, 1, 1 + k % 5, k % 24)) for k in range(40)]
    path = f"file://{tmp_path}/events.parquet"
    spark.createDataFrame(rows, "user_id long, ts timestamp").repartition(parts).write.parquet(path)
    want = {tuple(r) for r in windowed_counts(spark.read.parquet(path), "user_id", "ts", "1 day").collect()}
    got = {(r.key, r.start, r.n) for r in run_stream(spark, path, "user_id", "ts", "1 day").collect()}
    assert got == want and len(want) > 5


def test_queries_in_blocks_meet_every_row_once(spark, monkeypatch):
    from hyperweave.operators import neighbours as nb

    df = spark.createDataFrame([(k, [float(k % 7), 1.0]) for k in range(0, 900, 3)], "id long, v array<double>")
    whole = sorted((r.i, r.j, tuple(r.x.v)) for r in nb.against_all(df, "id").collect())
    monkeypatch.setattr(nb, "BLOCK_BYTES", 40)
    assert sorted((r.i, r.j, tuple(r.x.v)) for r in nb.against_all(df, "id").collect()) == whole
    assert len(whole) == 3 * 299
    assert nb.against_all(df.where("id < 0"), "id").collect() == []


def test_components_alike_with_and_without_hot_keys(spark):
    from hyperweave.operators.components import linked

    r = random.Random(4)
    links = [(0, k) for k in range(1, 40)] + [(k, k + 1) for k in range(100, 140)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(70)]
    r.shuffle(links)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    df = spark.createDataFrame(links, "u long, v long")
    for few in (0, 60, 1000):  # tables of links above it, nodes below it; all below it
        assert {x.node: x.comp for x in linked(df, (), few).collect()} == {x: find(x) for x in root}


def test_equal_rows_are_compared_once(spark, monkeypatch):
    """Pairs of ids come from classes of equal rows: as many comparisons as pairs of classes, whatever the ids."""
    from pyspark.sql import functions as F

    from hyperweave.operators import neighbours as nb

    queries = spark.createDataFrame([(100 * k, "ab" if k % 2 else "xyz") for k in range(6)], "i long, a string")
    rows = spark.createDataFrame([(k, ["ab", "abc", None][k % 3]) for k in range(300)], "j long, b string")
    done = spark.sparkContext.accumulator(0)

    def told(a, b):
        done.add(1)
        return None if b is None else len(a) - len(b)

    found = nb.compared(queries, rows, d=F.udf(told, "int")("a", "b"))
    got = sorted((r.i, r.j, -9 if r.d is None else r.d) for r in found.collect())
    a, b = {r.i: r.a for r in queries.collect()}, {r.j: r.b for r in rows.collect()}
    assert got == sorted((i, j, -9 if b[j] is None else len(a[i]) - len(b[j])) for i in a for j in b)
    assert done.value == 6  # 2 names and 3 words
    for ids in ("CLASS_IDS", "DEALT_IDS", "DEALT_QUERIES"):
        monkeypatch.setattr(nb, ids, 7)
    assert sorted((r.i, r.j, -9 if r.d is None else r.d) for r in nb.compared(queries, rows, d=F.udf(told, "int")("a", "b")).collect()) == got
    assert nb.compared(queries, rows.where("j < 0"), d=F.lit(1)).collect() == nb.compared(queries.where("i < 0"), rows, d=F.lit(1)).collect() == []


def test_records_of_equal_histograms_are_one_class(spark):
    from hyperweave.operators import distances, neighbours as nb

    rows = spark.sql("SELECT * FROM VALUES (1, map('a', 1, 'b', 2)), (2, map('b', 2, 'a', 1)), (3, map('a', 1)) AS t(id, h)")
    assert sorted(sorted(r.ids) for r in nb.classes(rows, "id").collect()) == [[1, 2], [3]]
    items = [(0, "a"), (0, "b"), (0, "b"), (1, "b"), (1, "a"), (1, "b"), (2, "c"), (100, "a")]
    found = distances.histogram_distances(spark.createDataFrame(items, "id long, k string"), "id", "k")
    got = {(r.i, r.j): (r.l1, round(r.chi2, 6)) for r in found.collect()}
    assert got == {(0, 1): (0, 0.0), (0, 2): (4, 2.0), (0, 100): (2, 1.0), (100, 0): (2, 1.0), (100, 1): (2, 1.0), (100, 2): (2, 1.0)}
