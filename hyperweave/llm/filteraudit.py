"""Interaction of filters: what each removes, alone and after the others, in every order in which they can be applied.

A document is known to the audit by the mask of the filters that it fails. Documents with equal part, mask and labels are
one class with a weight, so the texts are read once and never shuffled. In min-plus arithmetic the mask matrix (classes
by filters: 0 where the class fails, infinity elsewhere) times the position matrix (filters by orders: the step at which
the order applies the filter, that is the inverse of its permutation) is the step at which the order removes the class:
the minimum over its filters of their positions. Weights scattered to that step are what is removed there; a
filter that fails a class at a later step is redundant for it.

Whether a text equals that of a smaller id is told without a join: rows are counted by digest of the text and id, and of
each digest the rows of the smallest id are set apart; both steps combine before they shuffle, so a text that a third
of all rows share is no burden.

Defined results: a null text is the empty text; a null lang is the empty part. Rows without an id equal no smaller id and
are none themselves, and have no labels. Rows that repeat an id with one text are each counted, and none is the other's
copy. Of several label rows of an id, one that says 1 decides. Without documents there are no rows.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from hyperweave.functions.state import written

FILTERS = "ABCDE"
#: White space of words, marks of filter D (fixed values).
SPACE, MARKS, CAPITALS = r"[\x20\x09-\x0D]+", "[#$%&*|]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS = 200

KINDS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: the text fails filter A, B, C, D."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    fails = [n < MIN_WORDS, 100 * distinct < 50 * n, 100 * capitals > 3 * F.length(text), text.rlike(MARKS)]
    return sum((F.when(x, F.lit(1 << k)).otherwise(F.lit(0)) for k, x in enumerate(fails)), F.lit(0))


def classes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of each part fail exactly the filters of a mask."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("lang", F.lit("")).alias("part"),
        text_mask(text).alias("mask"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = said.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(said, "doc_id", "left").fillna(0, ["good", "toxic"])
    known = written(rows.groupBy("digest", "doc_id", "part", "mask", "good", "toxic").agg(F.count("*").alias("n")))
    each = F.struct("part", "mask", "good", "toxic", "n")
    # One id's rows of one text differ by their parts only.
    own = known.where("doc_id is not null").groupBy("digest", "doc_id").agg(F.collect_list(each).alias("own"))
    first = own.groupBy("digest").agg(F.min_by("own", "doc_id").alias("own")).select(F.explode("own").alias("c")).select("c.*")
    none = known.where("doc_id is null").select("part", "mask", "good", "toxic", "n")
    # Those of the smallest id, and those without an id, are no copies; of all others the filter E is failed too.
    alone = first.union(none)
    copies = known.select("part", (F.col("mask") + 16).alias("mask"), "good", "toxic", "n")
    copies = copies.union(alone.select("part", F.col("mask") + 16, "good", "toxic", -F.col("n")))
    found = alone.union(copies).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
    return found


def removal_steps(masks: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The min-plus product of (classes, filters) and (filters, orders): the step that removes the class, infinity if none."""
    return np.min(masks[:, :, None] + positions[None], axis=1)


def audited(docs: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step."""
    orders = ["".join(p) for p in permutations(sorted(filters))]
    n = len(filters)
    positions = np.array([[o.index(f) + 1 for o in orders] for f in filters], float)
    at = np.array([[filters.index(f) for f in o] for o in orders])

    def audit(f: pd.DataFrame) -> pd.DataFrame:
        failed = (f["mask"].to_numpy()[:, None] >> np.arange(n)) & 1 == 1
        weight = f["n"].to_numpy(np.int64)
        gone = removal_steps(np.where(failed, 0.0, np.inf), positions)
        step = np.where(np.isinf(gone), n + 1, gone).astype(int)
        order = np.broadcast_to(np.arange(len(orders)), step.shape)

        def scattered(w: np.ndarray) -> np.ndarray:
            out = np.zeros((len(orders), n + 2), np.int64)
            np.add.at(out, (order, step), np.broadcast_to(w[:, None], step.shape))
            return out[:, 1 : n + 1]

        removed = scattered(weight)
        fails = weight @ failed  # for each filter
        alone = weight @ (failed & (failed.sum(axis=1) == 1)[:, None])
        share = np.zeros(n, np.int64)
        np.add.at(share, at, removed)
        return pd.DataFrame(
            {
                "part": f["part"].iloc[0],
                "filter_order": np.repeat(orders, n),
                "step": np.tile(np.arange(1, n + 1), len(orders)),
                "kept": (weight.sum() - removed.cumsum(axis=1)).ravel(),
                "removed": removed.ravel(),
                "redundant": (fails[at] - removed).ravel(),
                "unique_fails": alone[at].ravel(),
                "good_lost": scattered(weight * f["good"].to_numpy()).ravel(),
                "toxic_lost": scattered(weight * f["toxic"].to_numpy()).ravel(),
                "shapley": share[at].ravel(),
            }
        )

    # A part has at most 4 rows for each mask.
    return classes(docs, labels).groupBy("part").applyInPandas(audit, KINDS)
