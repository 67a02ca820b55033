"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint becomes the vector of the bit counts of its sixteen 4-bit segments. One differing bit moves
one count by one, so the Manhattan distance of two vectors never exceeds the Hamming distance of the
fingerprints. The vectors lie on an integer grid: fingerprints within ``max_bits`` are found by joining each
one's cell with the cells within that Manhattan distance, and the join condition verifies exactly.

With sixteen segments a fingerprint goes to 273 cells, and two random ones meet in one of them with a chance of
3e-7, so candidates grow slowly with the square; with eight it would be 73 cells and 1.6e-4.

Defined results: null or empty texts and texts without words have fingerprint 0 and link like any other;
every input row gives one row; rows with the same text share one fingerprint, which is joined once. Rows that share
an id are separate documents.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import components, cut, give_back, row_key

SEGMENTS, BITS = 16, 4
SHINGLE = 3
SEED = 42
BLOCK = 1 << 15


def simhash(text: str | None, width: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) <= width:
        return digest(line, SEED)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    total = len(words) - width + 1
    votes = np.zeros(64, np.int64)
    for at in range(0, total, BLOCK):
        to = min(at + BLOCK, total)
        h = [digest(line[s : e - 1], SEED) for s, e in zip(starts[at:to], ends[at + width - 1 : to + width - 1])]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: list[str] = []) -> DataFrame:
    """(doc_id long, fp long): each row's fingerprint, as a signed long, and the columns of ``more``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), *batch.columns[2:]], ["doc_id", "fp", *more])
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *more)
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in more]
    return rows.mapInArrow(run, ", ".join(["doc_id long", "fp long", *kinds]))


def _steps(max_bits: int) -> list[int]:
    """Half of the grid steps of Manhattan length up to ``max_bits`` (of d and -d one), packed four bits a segment."""
    found = []
    for parts in range(max_bits + 1):
        for where in itertools.combinations(range(SEGMENTS), parts):
            for sizes in itertools.product([d for d in range(-max_bits, max_bits + 1) if d], repeat=parts):
                if sum(map(abs, sizes)) <= max_bits and (not sizes or sizes[0] > 0):
                    found.append(sum(d << (4 * i) for i, d in zip(where, sizes)))
    return found


def link_fingerprints(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp) at ``max_bits`` or fewer differing bits, each once.

    A row is copied to the cells of half a Manhattan ball (273 for two bits), never to another row, so the shuffle
    grows with the rows.
    """
    counts = [
        F.shiftleft(F.bit_count(F.shiftright(F.col("fp"), BITS * k).bitwiseAND(F.lit((1 << BITS) - 1))).cast("long"), 4 * k)
        for k in range(SEGMENTS)
    ]
    cell = sum(counts[1:], counts[0])
    at = fps.select("fp", cell.alias("cell"))
    steps = F.array(*[F.lit(s).cast("long") for s in _steps(max_bits)])
    left = at.select(F.col("fp").alias("a"), F.explode(steps).alias("step"), "cell")
    left = left.select("a", (F.col("cell") + F.col("step")).alias("cell1"), (F.col("step") == 0).alias("own"))
    right = at.select(F.col("fp").alias("b"), F.col("cell").alias("cell2"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    once = ~F.col("own") | (F.col("a") < F.col("b"))
    return left.join(right, (F.col("cell1") == F.col("cell2")) & near & once).select("a", "b")


def groups(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """(fp, grp): the component of each distinct fingerprint, named by one of its fingerprints."""
    comp = components(link_fingerprints(fps, max_bits))
    return fps.join(comp, fps.fp == comp.node, "left").select("fp", F.coalesce("comp", "fp").alias("grp"))


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2
) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``; the component's id is its smallest doc_id."""
    rows = cut(fingerprints(docs, id_col, text_col))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    named = fps.join(groups(fps.select("fp"), max_bits), "fp")
    least = named.groupBy("grp").agg(F.min("rep").alias("component_id"))
    return rows.join(named.join(least, "grp").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id, or of the least text hash among equals.

    Rows without an id stand after all others, so one of them stays only where its component has no id at all.
    """
    rows = docs.select(id_col, text_col, *row_key(id_col, text_col))
    fps = fingerprints(rows, id_col, text_col, ["_none", "_id", "_hash"])
    fps = cut(fps.groupBy("fp", "_none", "_id", "_hash").agg(F.count("*").alias("n")))
    first = fps.groupBy("fp").agg(F.min(F.struct("_none", "_id", "_hash", "n")).alias("first"))
    named = first.join(groups(first.select("fp"), max_bits), "fp")
    kept = cut(named.groupBy("grp").agg(F.min("first").alias("k")).select("k.*"))
    key = ["_none", "_id", "_hash"]
    keyed = docs.select("*", *row_key(id_col, text_col))
    # Only where equal rows repeat is one of them picked.
    single = keyed.join(kept.where("n = 1"), key, "left_semi")
    repeated = keyed.join(kept.where("n > 1"), key, "left_semi").dropDuplicates(key)
    return single.union(repeated).drop(*key)
