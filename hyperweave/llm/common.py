"""What several operators share: the shared folder, checkpoints, splits, row keys and components."""

from __future__ import annotations

import ctypes
import gc
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hyperweave.functions.state import cut, shared_dir
from hyperweave.operators.components import linked

#: Labelled ids up to which they are broadcast to the texts (about 50 MB); beyond that texts are dealt out by id.
BROADCAST_IDS = 2_000_000

__all__ = ["components", "cut", "fold", "give_back", "in_fold", "labelled_rows", "labelled_sample", "row_key", "shared_dir", "stable_order"]


def row_key(id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart by id and text, without nulls: whether there is an id, the id, and the text's hash."""
    number = F.col(id_col).cast("long")
    return [number.isNull().alias("_none"), F.coalesce(number, F.lit(0)).alias("_id"), F.xxhash64(text_col).alias("_hash")]


def give_back() -> None:
    """At a task's end: memory that it has freed goes back to the system, since other stages use the worker next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries keep it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def fold(col: str, parts: int):
    """crc32 of the id as text, modulo ``parts``; null ids belong to no fold."""
    return F.crc32(F.col(col).cast("string")) % F.lit(parts)


def in_fold(col: str, parts: int, which: int):
    return F.coalesce(fold(col, parts) == which, F.lit(False))


def stable_order(*cols: str):
    """A seeded pseudo-random order that depends on the rows only, for bounded training samples."""
    return F.xxhash64(*[F.col(c) for c in cols], F.lit("sample"))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, max_docs: int, max_chars: int
) -> list[tuple[str, int]]:
    """About ``max_docs`` labelled texts outside the held-out fold, none beyond ``max_chars``, picked by a hash of the id.

    Null labels and null texts teach nothing; of texts that share an id the least is taken. The sample is bounded by
    its two parameters.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~in_fold("doc_id", parts, held_out))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).alias("_label"))
    share = max_docs / max(1, known.count())
    known = known.where(F.pmod(stable_order("_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    texts = docs.where(F.length("text") <= max_chars).select(F.col("doc_id"), "text")
    picked = texts.join(F.broadcast(known), texts.doc_id == known._id).groupBy("_id", "_label").agg(F.min("text").alias("text"))
    rows = picked.collect()
    rows.sort(key=lambda r: (r._id, r.text))
    return [(r.text, int(r._label)) for r in rows]


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, rows: int) -> DataFrame:
    """(_id, label, text) of every labelled text outside the held-out fold, whole, about ``rows`` in a partition by id.

    Label 1 is 1, any other 0. Null labels and null texts teach nothing; of texts that share an id the least is taken.
    Within a partition rows are in the order of a hash of the id.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~in_fold("doc_id", parts, held_out))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).alias("_label"))
    n = known.count()
    dealt = max(1, -(-n // rows))
    texts = docs.where(F.col("text").isNotNull() & ~in_fold("doc_id", parts, held_out)).select(F.col("doc_id").alias("_id"), "text")
    if n <= BROADCAST_IDS:
        met = texts.join(F.broadcast(known), "_id").repartition(dealt, "_id")
    else:
        met = texts.repartition(dealt, "_id").join(known, "_id")
    met = met.groupBy("_id").agg(F.max("_label").alias("_label"), F.min("text").alias("text")).coalesce(dealt)
    return met.select("_id", (F.col("_label") == 1).cast("int").alias("label"), "text").sortWithinPartitions(stable_order("_id"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: one row (node, comp) for each node that is linked with another one.

    ``comp`` is the smallest node reachable. All state stays in tables of the shared folder.
    """
    return linked(links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")))
