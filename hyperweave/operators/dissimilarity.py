"""Spectra of tables of dissimilarities, and how many dimensions stand out from chance.

Dissimilarities are rows (grp, i, j, d), one for each pair i < j of a group; a group's matrix is its squares, doubly centred.
It is never formed. A block of vectors is multiplied by it in a join of the pairs with the vectors' rows, made orthogonal to
all earlier blocks by sums of products, and added to them; all groups take each step together. Where a block brings nothing
new, drawn vectors go on, so that eigenvalues of any multiplicity are found. What the blocks span holds the greatest
eigenvalues on both sides of zero, and the whole spectrum once it has as many dimensions as the group has items less one. Only matrices of a block's width times the steps are solved, one for each group, inside tasks.

Pairs with a null take no part; a pair that is missing counts as zero. Groups need two items. An empty table has no spectrum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.state import numbered, written
from .statistics import hashed

#: Vectors that are multiplied at once, and such steps: 24 dimensions.
BLOCK, STEPS = 4, 6
#: A direction of less than this share of a block's length is one that earlier blocks hold.
TOLERANCE = 1e-6
#: An eigenvalue of less than this share of the greatest is rounding, not a dimension.
ROUNDING = 1e-9


def _products(rows: DataFrame, left: str, right: str) -> DataFrame:
    """(grp, m): for each group the sum over its rows of the products of two arrays, flattened; tasks are summed first."""

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for f in frames:
            for grp, part in f.groupby("grp"):
                own = np.array(part["l"].tolist()).T @ np.array(part["r"].tolist())
                total[grp] = total[grp] + own if grp in total else own
        if total:
            yield pd.DataFrame({"grp": list(total), "m": [x.ravel() for x in total.values()]})

    parts = rows.select("grp", F.col(left).alias("l"), F.col(right).alias("r")).mapInPandas(local, "grp string, m array<double>")
    sums = parts.select("grp", F.posexplode("m").alias("at", "x")).groupBy("grp", "at").agg(F.sum("x").alias("x"))
    return sums.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("m"))


def _orthonormal(state: DataFrame) -> DataFrame:
    """``state`` (grp, i, basis, images, z) with ``z`` orthogonal to ``basis`` and orthonormal; what depends on the rest becomes zero.

    If there is a column ``fresh``, its vectors take the place of those instead, to be made orthogonal in turn.
    """
    both = state.withColumn("_l", F.concat("basis", "z"))
    found = _products(both, "_l", "z")

    def turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            solved: dict = {}
            fresh = f["fresh"] if "fresh" in f else f["z"]
            for grp, basis, z, m, other in zip(f["grp"], f["basis"], f["z"], f["m"], fresh):
                if grp not in solved:
                    held = np.asarray(m).reshape(-1, len(z))
                    p, g = held[: -len(z)], held[-len(z) :]
                    values, u = np.linalg.eigh((g - p.T @ p + (g - p.T @ p).T) / 2)
                    scale = np.where(values > TOLERANCE**2 * max(float(np.trace(g)), 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0)
                    solved[grp] = p, u * scale
                p, u = solved[grp]
                new = (z - basis @ p) @ u
                out.append(np.where(u.any(axis=0), new, other) if "fresh" in f else new)
            yield f[kept].assign(z=out)

    kept = ["grp", "i", "basis", "images", "z"]
    return state.join(found, "grp").mapInPandas(turn, state.select(*kept).schema)


def spectra(dist: DataFrame, block: int = BLOCK, steps: int = STEPS, seed: int = 1) -> DataFrame:
    """(grp, rank, value, whole): each group's eigenvalues, greatest first, and whether these are all but the one of the constant vector.

    ``grp`` comes back as text. ``block`` x ``steps`` values are found at most.
    """
    rows = dist.where("grp IS NOT NULL AND i IS NOT NULL AND j IS NOT NULL AND d IS NOT NULL AND i <> j").select(
        F.col("grp").cast("string").alias("grp"), "i", "j", (F.col("d").cast("double") * F.col("d")).alias("s")
    )
    pairs = written(rows.union(rows.select("grp", F.col("j").alias("i"), F.col("i").alias("j"), "s")))
    items = pairs.select("grp", "i").distinct()
    n = items.groupBy("grp").agg(F.count("*").alias("n"))
    drawn = lambda step: F.array(*[hashed(F.col("i"), F.lit(k), F.lit(step), F.lit(seed)) / float(1 << 32) - 0.5 for k in range(block)])
    none = F.array().cast("array<double>")
    state = items.join(n, "grp").select("grp", "i", F.array((1 / F.sqrt("n")).cast("double")).alias("basis"), none.alias("images"), drawn(0).alias("z"))
    state = written(_orthonormal(written(_orthonormal(written(state)))))
    for step in range(steps):
        mine = state.select("grp", F.col("i").alias("j"), "z")
        moved = pairs.join(mine, ["grp", "j"]).groupBy("grp", "i").agg(*[F.sum(F.col("s") * F.col("z")[k]).alias(f"_{k}") for k in range(block)])
        image = F.array(*[-0.5 * F.col(f"_{k}") for k in range(block)])
        known = state.select("grp", "i", F.concat("basis", "z").alias("basis"), "images")
        state = known.join(moved, ["grp", "i"]).select("grp", "i", "basis", F.concat("images", image).alias("images"), image.alias("z"))
        state = written(state)
        if step < steps - 1:
            state = written(_orthonormal(written(_orthonormal(state.withColumn("fresh", drawn(step + 1))))))
    # The first vector is the constant one, which the centring takes out of every image.
    found = _products(state.withColumn("_l", F.slice("basis", 2, block * steps)), "_l", "images")
    lengths = _products(state.withColumn("_l", F.slice("basis", 2, block * steps)), "_l", "_l").withColumnRenamed("m", "g")

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for grp, m, g, items in zip(f["grp"], f["m"], f["g"], f["n"]):
                side = block * steps
                live = np.flatnonzero(np.asarray(g).reshape(side, side).diagonal() > 0.5)
                h = np.asarray(m).reshape(side, side)[np.ix_(live, live)]
                values = np.linalg.eigvalsh((h + h.T) / 2)[::-1]
                yield pd.DataFrame({"grp": grp, "rank": np.arange(1, len(values) + 1), "value": values, "whole": len(live) >= items - 1})

    return found.join(lengths, "grp").join(n, "grp").mapInPandas(solve, "grp string, rank int, value double, whole boolean")


def permuted(dist: DataFrame, draws: int, seed: int) -> DataFrame:
    """``dist`` as draw 0, and ``draws`` times with each group's dissimilarities dealt to its pairs in an order of digests."""
    rows = written(dist.where("grp IS NOT NULL AND i IS NOT NULL AND j IS NOT NULL AND d IS NOT NULL").select("grp", "i", "j", F.col("d").cast("double").alias("d")))
    many = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    mixed = many.withColumn("_h", hashed(F.col("i"), F.col("j"), F.col("draw"), F.lit(seed)))
    places = numbered(many.select("grp", "draw", "i", "j"), ["grp", "draw"], ["i", "j"], "_at")
    dealt = numbered(mixed, ["grp", "draw"], ["_h", "i", "j"], "_at").select("grp", "draw", "_at", "d")
    new = places.join(dealt, ["grp", "draw", "_at"]).select("grp", "draw", "i", "j", "d")
    return rows.select("grp", F.lit(0).alias("draw"), "i", "j", "d").union(new)


def dimensions(dist: DataFrame, draws: int, share: float = 0.95, block: int = BLOCK, steps: int = STEPS, seed: int = 1) -> DataFrame:
    """(grp, found, dimensions, negative, whole): eigenvalues found, how many of them are above zero and above the ``share``
    quantile of those of their rank in ``draws`` permutations, and the share of the spectrum that is below zero.

    That share is of all eigenvalues only where ``whole`` says so. ``grp`` comes back as text.
    """
    all_draws = permuted(dist, draws, seed).withColumn("grp", F.concat_ws("\u001f", "draw", F.col("grp").cast("string")))
    values = written(spectra(all_draws, block, steps, seed))
    values = values.select(F.substring_index("grp", "\u001f", 1).cast("int").alias("draw"), F.expr("substring(grp, instr(grp, '\u001f') + 1)").alias("grp"), "rank", "value", "whole")
    chance = values.where("draw > 0").groupBy("grp", "rank").agg(F.percentile("value", share).alias("chance"))
    most = values.where("draw = 0").groupBy("grp").agg(F.max(F.abs("value")).alias("most"))
    out = values.where("draw = 0").join(chance, ["grp", "rank"], "left").join(most, "grp")
    beyond = (F.col("value") > ROUNDING * F.col("most")) & (F.col("value") > F.coalesce("chance", F.lit(0.0)))
    negative = F.try_divide(F.sum(F.greatest(-F.col("value"), F.lit(0.0))), F.sum(F.abs("value")))
    return out.groupBy("grp").agg(F.count("*").alias("found"), F.count_if(beyond).alias("dimensions"), negative.alias("negative"), F.min("whole").alias("whole"))
