"""Collections as block-structured text, and single hypergraphs as three line-aligned text files.

Block files: the first line is the number of records; each record is a line ``constants facts class``, a line with the
constants' labels and a line with the members of each fact, all whole numbers. Blocks have no marks, so a file is read
from its start; the writer therefore closes a file once it holds FILE_BYTES, and each file is a task of its own. A file
from elsewhere is streamed by one task, a record at a time.

Labelled files: ``hyperedges-<name>.txt`` has a line for each fact, its members separated by commas; line i of
``node-labels-<name>.txt`` the numbers of node i's labels; line i of ``label-names-<name>.txt`` the name of label i. All
numbers start at 1. Each of them may be a folder of files, whose lines count on in the order of the files' names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.state import numbered
from ..operators.hypergraph import compact

#: Name of the source, and the list of the files that a finished write consists of.
FORMAT, MANIFEST = "hypergraph_blocks", "_files.json"
SCHEMA = "file string, block long, class long, labels array<long>, facts array<array<long>>"
#: A file is closed once it has so many bytes; a record is never divided.
FILE_BYTES = 32_000_000


class BlockError(ValueError):
    """A file that is not block-structured text."""


@dataclass
class BlockFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def _numbers(line: bytes, path: str) -> list[int]:
    try:
        return [int(x) for x in line.split()]
    except ValueError as error:
        raise BlockError(f"{path}: not whole numbers: {line[:80]!r}") from error


def _lines(system: fs.FileSystem, path: str) -> Iterator[bytes]:
    rest = b""
    with system.open_input_stream(path) as stream:
        while piece := stream.read(1 << 20):
            *whole, rest = (rest + piece).split(b"\n")
            yield from whole
    if rest:
        yield rest


class BlockReader(DataSourceReader):
    """Reads the columns that are asked for; labels and members of others are passed over unparsed."""

    def __init__(self, columns: list[str], options: dict[str, str]):
        self.columns = columns
        self.root = options["path"]
        chosen = options.get("classes")
        self.classes = None if chosen is None else {int(c) for c in chosen.split(",") if c}

    def partitions(self) -> list[BlockFile]:
        system, root = fs.FileSystem.from_uri(self.root)
        if system.get_file_info(root).type == fs.FileType.File:
            return [BlockFile(root)]
        if system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            with system.open_input_stream(f"{root}/{MANIFEST}") as f:
                return [BlockFile(f"{root}/{name}") for name in json.loads(f.read())]
        found = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
        return [BlockFile(path) for path in sorted(found)]

    def read(self, partition: BlockFile | None) -> Iterator[tuple]:
        if partition is None:  # no files at all
            return
        system, _ = fs.FileSystem.from_uri(self.root)
        path = partition.path
        lines = _lines(system, path)

        def line() -> bytes:
            found = next(lines, None)
            if found is None:
                raise BlockError(f"{path} ends within a record")
            return found

        first = _numbers(line(), path)
        if len(first) != 1:
            raise BlockError(f"{path}: its first line is not a number of records")
        for block in range(first[0]):
            head = _numbers(line(), path)
            if len(head) != 3:
                raise BlockError(f"{path}: record {block} starts with {head}")
            n, m, own = head
            wanted = self.classes is None or own in self.classes
            labels, members = line(), [line() for _ in range(m)]
            if not wanted:
                continue
            row = {"file": path, "block": block, "class": own}
            if "labels" in self.columns:
                row["labels"] = _numbers(labels, path)
                if len(row["labels"]) != n:
                    raise BlockError(f"{path}: record {block} has {len(row['labels'])} labels for {n} constants")
            if "facts" in self.columns:
                row["facts"] = [sorted(set(_numbers(f, path))) for f in members]
                if any(v < 0 or v >= n for f in row["facts"] for v in f):
                    raise BlockError(f"{path}: record {block} has members beyond its {n} constants")
            yield tuple(row[c] for c in self.columns)
        if any(rest.strip() for rest in lines):
            raise BlockError(f"{path} goes on after its {first[0]} records")


class BlockWriter(DataSourceWriter):
    """Each task writes files of names of their own; only those of tasks that committed are in the list."""

    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite = root, overwrite

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = fs.FileSystem.from_uri(self.root)
        system.create_dir(root, recursive=True)
        names: list[str] = []
        held: list[str] = []
        size = 0

        def close() -> None:
            name = f"part-{uuid.uuid4().hex}.txt"
            with system.open_output_stream(f"{root}/{name}") as f:
                f.write(f"{len(held)}\n".encode())
                f.write("".join(held).encode())
            names.append(name)
            held.clear()

        for row in iterator:
            facts = row["facts"]
            lines = [f"{len(row['labels'])} {len(facts)} {row['class']}", " ".join(map(str, row["labels"])), *(" ".join(map(str, f)) for f in facts)]
            held.append("\n".join(lines) + "\n")
            size += len(held[-1])
            if size >= FILE_BYTES:
                close()
                size = 0
        if held:
            close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.root)
        system.create_dir(root, recursive=True)
        names = [name for m in messages if m for name in m.files]
        path = f"{root}/{MANIFEST}"
        if not self.overwrite and system.get_file_info(path).type == fs.FileType.File:
            with system.open_input_stream(path) as f:
                names = json.loads(f.read()) + names
        with system.open_output_stream(path) as f:
            f.write(json.dumps(sorted(names)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.root)
        for name in [name for m in messages if m for name in m.files]:
            system.delete_file(f"{root}/{name}")


class BlockSource(DataSource):
    """Options: path; classes, to read records of these classes only. The schema may be any columns of SCHEMA."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BlockReader:
        return BlockReader(schema.names, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> BlockWriter:
        return BlockWriter(self.options["path"], overwrite)


def read_blocks(spark: SparkSession, path: str, columns: list[str] | None = None, classes: list[int] | None = None) -> DataFrame:
    """(file, block, class, labels, facts) of block files, or some of these columns, of some classes."""
    spark.dataSource.register(BlockSource)
    reader = spark.read.format(FORMAT)
    if columns:
        kinds = dict(c.split(" ", 1) for c in SCHEMA.split(", "))
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    if classes is not None:
        reader = reader.option("classes", ",".join(map(str, classes)))
    return reader.load(path)


def write_blocks(records: DataFrame, path: str) -> None:
    """Write records (class, labels, facts) as block files; what was there before is no longer in the list of files."""
    records.sparkSession.dataSource.register(BlockSource)
    records.select("class", "labels", "facts").write.format(FORMAT).mode("overwrite").save(path)


def to_blocks(inc: DataFrame, own: str, label: str) -> DataFrame:
    """(hg, class, labels, facts): one row a record, constants numbered from 0 within it, repeated facts kept."""
    ranked = inc.join(compact(inc), ["hg", "v"])
    labels = F.transform(F.array_sort(F.collect_set(F.struct("new_v", F.col(label).cast("long").alias("label")))), lambda x: x["label"])
    heads = ranked.groupBy("hg").agg(F.min(own).cast("long").alias("class"), labels.alias("labels"))
    facts = ranked.groupBy("hg", "e").agg(F.sort_array(F.collect_set(F.col("new_v").cast("long"))).alias("f"))
    return heads.join(facts.groupBy("hg").agg(F.sort_array(F.collect_list("f")).alias("facts")), "hg")


def _aligned(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of a text file or folder numbered from 0 in their order."""
    place = ["_metadata.file_name", "_metadata.file_block_start"]
    rows = spark.read.text(path).select("value", F.col(place[0]).alias("f"), F.col(place[1]).alias("b"), F.monotonically_increasing_id().alias("k"))
    return numbered(rows, [], ["f", "b", "k"], "line").select("line", "value")


def _parts(col: str) -> Column:
    return F.filter(F.split(F.trim(col), ","), lambda x: x != "")


def read_labelled(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    """((e, v), (v, symbol)): the incidences of a labelled hypergraph and each node's symbol, its sorted label names joined by commas.

    Facts and nodes are numbered from 0 by their lines; empty lines of facts are passed over. A node without labels has the
    empty symbol. Numbers that are none or out of range are errors.
    """
    names = _aligned(spark, f"{folder}/label-names-{name}.txt").select((F.col("line") + 1).alias("label"), F.col("value").alias("name"))
    nodes = _aligned(spark, f"{folder}/node-labels-{name}.txt").select(F.col("line").alias("v"), "value")
    given = nodes.select("v", F.explode(_parts("value")).alias("label")).withColumn("label", F.col("label").cast("long"))
    known = given.join(names, "label", "left")
    checked = F.when(F.col("name").isNull(), F.raise_error(F.concat(F.lit("unknown label "), F.col("label")))).otherwise(F.col("name"))
    symbols = known.select("v", checked.alias("name")).groupBy("v").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("symbol"))
    symbols = nodes.select("v").join(symbols, "v", "left").select("v", F.coalesce("symbol", F.lit("")).alias("symbol"))
    lines = _aligned(spark, f"{folder}/hyperedges-{name}.txt").where(F.trim("value") != "")
    members = lines.select(F.col("line").alias("e"), F.explode(_parts("value")).alias("v")).select("e", F.col("v").cast("long").alias("v"))
    wrong = ~F.col("v").between(1, nodes.count())
    inside = F.when(wrong, F.raise_error(F.concat(F.lit("unknown node "), F.col("v")))).otherwise(F.col("v") - 1)
    return members.distinct().select("e", inside.alias("v")), symbols


def write_labelled(inc: DataFrame, labels: DataFrame, folder: str, name: str) -> None:
    """Write incidences (e, v) and labels (v, name; several rows a node) as a labelled hypergraph.

    Facts, nodes and names take the lines of their order; nodes are those of ``labels``, and a null name is no label.
    """
    names = numbered(labels.select("name").dropna().distinct(), [], ["name"], "k")
    nodes = numbered(labels.select("v").distinct(), [], ["v"], "at")
    used = labels.join(names, "name").groupBy("v").agg(F.array_join(F.sort_array(F.collect_set(F.col("k") + 1)), ",").alias("value"))
    facts = inc.join(nodes, "v").groupBy("e").agg(F.array_join(F.sort_array(F.collect_set(F.col("at") + 1)), ",").alias("value"))
    _ordered(names.select("k", F.col("name").alias("value")), "k", f"{folder}/label-names-{name}.txt")
    _ordered(nodes.join(used, "v", "left").select("at", F.coalesce("value", F.lit("")).alias("value")), "at", f"{folder}/node-labels-{name}.txt")
    _ordered(facts, "e", f"{folder}/hyperedges-{name}.txt")


def _ordered(rows: DataFrame, order: str, path: str) -> None:
    """Lines in their order over files in the order of their names."""
    rows.repartitionByRange(order).sortWithinPartitions(order).select("value").write.mode("overwrite").text(path)
