"""Block-structured and line-aligned text against plain parsers."""

import random

import pytest

from hyperweave.sources import blocks as bl


def text_of(records) -> str:
    lines = [str(len(records))]
    for own, labels, facts in records:
        lines += [f"{len(labels)} {len(facts)} {own}", " ".join(map(str, labels)), *(" ".join(map(str, f)) for f in facts)]
    return "\n".join(lines) + "\n"


@pytest.fixture(scope="module")
def records():
    rng = random.Random(3)
    made = []
    for k in range(40):
        n = rng.randrange(1, 9)
        facts = [sorted(rng.sample(range(n), rng.randrange(1, n + 1))) for _ in range(rng.randrange(0, 6))]
        made.append((k % 4, [rng.randrange(5) for _ in range(n)], facts))
    return made


def rows(df):
    return sorted((r["class"], list(r["labels"]), [list(f) for f in r["facts"]]) for r in df.collect())


def test_files_from_elsewhere(spark, tmp_path, records):
    path = tmp_path / "a.txt"
    path.write_text(text_of(records))
    uri = f"file://{path}"
    got = bl.read_blocks(spark, uri)
    assert rows(got) == sorted(records)
    assert [r.block for r in got.sort("block").collect()] == list(range(40))
    assert rows(bl.read_blocks(spark, uri, classes=[1, 3])) == sorted(r for r in records if r[0] in (1, 3))
    assert bl.read_blocks(spark, uri, classes=[]).count() == 0
    few = bl.read_blocks(spark, uri, columns=["class", "labels"])
    assert few.columns == ["class", "labels"] and few.count() == 40
    # A folder of files, one of them without a line end, repeated members, blank lines at the end.
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "1.txt").write_text("1\n2 1 7\n0 1\n1 0 1\n\n")
    (folder / "2.txt").write_text("1\n1 1 8\n0\n0")
    (folder / "3.txt").write_text("0\n")
    (folder / "_other").write_text("no")
    assert rows(bl.read_blocks(spark, f"file://{folder}")) == [(7, [0, 1], [[0, 1]]), (8, [0], [[0]])]


@pytest.mark.parametrize(
    "text",
    ["", "x\n", "1 2\n", "2\n1 0 0\n0\n", "1\n1 1\n0\n0\n", "1\n2 1 0\n0\n0 1\n", "1\n1 1 0\n0\n1\n", "1\n1 1 0\n0\n0\n0\n", "1\n1 1 0\n0\na\n"],
)
def test_what_is_not_block_structured_is_an_error(spark, tmp_path, text):
    (tmp_path / "a.txt").write_text(text)
    with pytest.raises(Exception, match="a.txt"):
        bl.read_blocks(spark, f"file://{tmp_path}/a.txt").collect()


def test_round_trip_over_many_files(spark, tmp_path, records, monkeypatch):
    given = spark.createDataFrame(records, "class long, labels array<long>, facts array<array<long>>").repartition(3)
    path = f"file://{tmp_path}/out"
    bl.write_blocks(given, path)
    (tmp_path / "out" / "part-lost.txt").write_text("what a lost task left")
    assert rows(bl.read_blocks(spark, path)) == sorted(records)
    bl.write_blocks(given.where("class = 2"), path)
    assert rows(bl.read_blocks(spark, path)) == sorted(r for r in records if r[0] == 2)
    bl.write_blocks(given.limit(0), path)
    assert bl.read_blocks(spark, path).count() == 0


def test_a_task_closes_files_that_are_full(tmp_path, records, monkeypatch):
    monkeypatch.setattr(bl, "FILE_BYTES", 100)
    keys = ("class", "labels", "facts")
    writer = bl.BlockWriter(f"file://{tmp_path}/out", True)
    done = writer.write(iter([dict(zip(keys, r)) for r in records]))
    gone = writer.write(iter([dict(zip(keys, records[0]))]))
    writer.commit([done, None])
    assert len(done.files) > 5
    reader = bl.BlockReader(list(keys), {"path": f"file://{tmp_path}/out"})
    found = sorted(row for p in reader.partitions() for row in reader.read(p))
    assert found == sorted(records)
    writer.abort([gone])
    assert not (tmp_path / "out" / gone.files[0]).exists()


def test_labelled_files(spark, tmp_path):
    folder = tmp_path / "x"
    folder.mkdir()
    (folder / "label-names-x.txt").write_text("red\nblue\ngreen\n")
    (folder / "node-labels-x.txt").write_text("2,1\n3\n\n1\n")
    (folder / "hyperedges-x.txt").write_text("1,2\n\n4, 3,4\n1,2\n")
    inc, symbols = bl.read_labelled(spark, f"file://{folder}", "x")
    assert sorted(map(tuple, symbols.collect())) == [(0, "blue,red"), (1, "green"), (2, ""), (3, "red")]
    assert sorted(map(tuple, inc.collect())) == [(0, 0), (0, 1), (2, 2), (2, 3), (3, 0), (3, 1)]
    (folder / "hyperedges-x.txt").write_text("1,5\n")
    with pytest.raises(Exception, match="unknown node 5"):
        bl.read_labelled(spark, f"file://{folder}", "x")[0].collect()
    (folder / "node-labels-x.txt").write_text("4\n")
    with pytest.raises(Exception, match="unknown label 4"):
        bl.read_labelled(spark, f"file://{folder}", "x")[1].collect()


def test_labelled_round_trip_over_many_files(spark, tmp_path):
    rng = random.Random(9)
    inc = sorted({(e, rng.randrange(100, 400)) for e in range(500) for _ in range(3)})
    labels = [(v, f"name {rng.randrange(12)}") for v in range(100, 400) for _ in range(2)] + [(400, None)]
    given = spark.createDataFrame(inc, "e long, v long").repartition(5), spark.createDataFrame(labels, "v long, name string").repartition(4)
    bl.write_labelled(*given, f"file://{tmp_path}/r", "r")
    back, symbols = bl.read_labelled(spark, f"file://{tmp_path}/r", "r")
    assert sorted(map(tuple, back.collect())) == [(e, v - 100) for e, v in inc]
    want = {v: ",".join(sorted({n for w, n in labels if w == v and n})) for v in range(100, 401)}
    assert {r.v + 100: r.symbol for r in symbols.collect()} == want
