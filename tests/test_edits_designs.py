"""Edits, designs, formats and statistics on small cases."""

import itertools
import math

import pytest

from hyperweave.functions import designs as ds
from hyperweave.operators import distances, edits, statistics as st
from hyperweave.sources import formats

EDGES = {0: (0, 1, 2), 1: (1, 3), 2: (2, 3, 4)}


@pytest.fixture(scope="module")
def inc(spark):
    return spark.createDataFrame([(7, e, v) for e, m in EDGES.items() for v in m], "hg long, e int, v int")


def sets(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.e, set()).add(r.v)
    return out


def test_fact_edits(spark, inc):
    more = spark.createDataFrame([(7, [4, 0]), (7, [3, 1]), (7, [0, 4, 4])], "hg long, members array<int>")
    assert sorted(map(sorted, sets(edits.insert_facts(inc, more)).values())) == [[0, 1, 2], [0, 4], [1, 3], [2, 3, 4]]
    gone = spark.createDataFrame([(7, 0)], "hg long, e int")
    assert sets(edits.delete_facts(inc, gone)) == {0: {1, 3}, 1: {2, 3, 4}}
    assert sets(edits.delete_constants(inc, spark.createDataFrame([(7, 3)], "hg long, v int"))) == {0: {0, 1, 2}, 1: {1}, 2: {2, 4}}


def test_swap_keeps_degrees_and_arities(spark, inc):
    swaps = spark.createDataFrame([(7, 0, 0, 2, 4), (7, 0, 1, 1, 3)], "hg long, e1 int, v1 int, e2 int, v2 int")
    assert sets(edits.swap_incidences(inc, swaps.where("v1 = 0"))) == {0: {4, 1, 2}, 1: {1, 3}, 2: {2, 3, 0}}
    assert sets(edits.swap_incidences(inc, swaps.where("v1 = 1"))) == {e: set(m) for e, m in EDGES.items()}  # 1 is in both


def test_anonymise_is_a_bijection(inc):
    got = sets(edits.anonymise(inc, 5))
    assert sorted(len(m) for m in got.values()) == [2, 3, 3] and set().union(*got.values()) == set(range(5))


def test_down_neighbours(inc):
    rows = edits.down_neighbours(inc).collect()
    assert sum(r.kind == "fact" for r in rows) == 3 and {(r.e, r.v) for r in rows if r.kind == "constant"} == {(e, v) for e in (0, 2) for v in EDGES[e]}


def test_subsets(spark):
    got = edits.subsets(spark.createDataFrame([(1, [3, 5, 8]), (2, [])], "id int, xs array<int>"), "xs", 2).collect()
    own = sorted(tuple(r.subset) for r in got if r.id == 1)
    assert own == sorted(c for n in range(3) for c in itertools.combinations([3, 5, 8], n)) and [r.subset for r in got if r.id == 2] == [[]]


def blocks(df):
    return [tuple(r.members) for r in df.collect()]


@pytest.mark.parametrize(
    "make, points, lines, size, degree",
    [
        (lambda s: ds.fano_plane(s), 7, 7, 3, 3),
        (lambda s: ds.affine_plane(s, 3), 9, 12, 3, 4),
        (lambda s: ds.affine_plane(s, 5), 25, 30, 5, 6),
        (lambda s: ds.cyclic(s, 13, [0, 1, 4]), 13, 13, 3, 3),
        (lambda s: ds.generalised_quadrangle(s), 15, 15, 3, 3),
        (lambda s: ds.complete_uniform(s, 6, 3), 6, 20, 3, 10),
        (lambda s: ds.loose(s, 5, 3, closed=True), 10, 5, 3, None),
        (lambda s: ds.tight(s, 7, 3, closed=True), 7, 7, 3, 3),
    ],
)
def test_designs(spark, make, points, lines, size, degree):
    found = blocks(make(spark))
    count = {}
    for b in found:
        assert len(b) == size
        for v in b:
            count[v] = count.get(v, 0) + 1
    assert len(found) == lines and len(count) == points
    assert degree is None or set(count.values()) == {degree}


@pytest.mark.parametrize("make", [ds.fano_plane, lambda s: ds.affine_plane(s, 3)])
def test_every_pair_is_in_one_block(spark, make):
    pairs = [p for b in blocks(make(spark)) for p in itertools.combinations(b, 2)]
    assert len(pairs) == len(set(pairs)) == math.comb(len({v for p in pairs for v in p}), 2)


def test_paths_and_random(spark):
    assert blocks(ds.loose(spark, 3, 3)) == [(0, 1, 2), (2, 3, 4), (4, 5, 6)] and blocks(ds.tight(spark, 5, 3)) == [(0, 1, 2), (1, 2, 3), (2, 3, 4)]
    got = blocks(ds.random_uniform(spark, 12, 3, 0.3, 1))
    assert got == blocks(ds.random_uniform(spark, 12, 3, 0.3, 1)) and 30 < len(got) < 110


def test_formats(spark, inc, tmp_path):
    from pyspark.sql import functions as F

    nested = formats.nest(inc.withColumn("pred", F.lit("p")))
    formats.write_jsonl(nested, f"file://{tmp_path}/kb")
    back = formats.unnest(formats.read_jsonl(spark, f"file://{tmp_path}/kb"))
    assert sorted(map(sorted, sets(back).values())) == sorted(map(sorted, EDGES.values()))
    lines = spark.createDataFrame([("Q1,P1,Q2,P3,Q4,P5,Q6",), ("Q1,P2,Q3",), ("Q9",)], "line string")
    got = formats.statements(lines, "line", ",").collect()
    assert [(r.subject, r.relation, r.members, r.qualifiers) for r in got] == [("Q1", "P1", ["Q2", "Q4", "Q6"], ["P3", "P5"]), ("Q1", "P2", ["Q3"], []), ("Q9", None, [], [])]
    cut = formats.simplices(spark.createDataFrame([([2, 2, 3], [1, 2, 2, 1, 1, 2, 3], [0, 0, 5])], "nverts array<int>, flat array<int>, times array<int>"))
    assert [(r.sid, r.ts, r.members) for r in cut.orderBy("sid").collect()] == [(0, 0, [1, 2]), (1, 0, [1, 2]), (2, 5, [1, 2, 3])]
    (tmp_path / "t.tsv").write_text("a\tQ1,Q2\nb\tQ3\n")
    assert [(r.entity, r.types) for r in formats.types_table(spark, f"file://{tmp_path}/t.tsv").collect()] == [("a", ["Q1", "Q2"]), ("b", ["Q3"])]


def test_token_levenshtein(spark):
    rows = [(0, ["a", "b", "c"]), (1, ["a", "c"]), (2, ["x", "a", "b", "c", "long token"]), (3, [])]
    got = {r.j: r.d for r in distances.token_levenshtein(spark.createDataFrame(rows, "id int, w array<string>"), "id", "w").collect()}
    assert got == {1: 1, 2: 2, 3: 3}


def test_folds_are_even(spark):
    rows = [(i, i % 3) for i in range(100)]
    got = st.folds(spark.createDataFrame(rows, "id int, label int"), "id", "label", 5, 1).groupBy("label", "fold").count().collect()
    assert len(got) == 15 and {r["count"] for r in got} <= {6, 7}


def test_bootstrap_covers_the_mean(spark):
    rows = [("a", float(i % 10), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v double, id long")
    r = st.bootstrap_mean(df, "k", "v", "id", 60, 1).collect()[0]
    assert st.bootstrap_mean(df.repartition(7), "k", "v", "id", 60, 1).collect()[0] == r
    assert r.low < r.mean < r.high and r.high - r.low < 1.0
