"""Disjoint neighbourhood blocks of a graph, drawn in rounds.

A block is a seed with some of its neighbours. In a round every node that still has enough free neighbours proposes a block:
itself and the free neighbours of the least seeded digests. Each node then goes to the proposal of the least digest among those
that hold it, and a proposal that gets all its nodes is drawn. The least proposal of all is always drawn, so each round ends
with fewer free nodes, and the rounds end when no node can propose: the blocks are disjoint, and no further one fits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.state import written
from .statistics import hashed

#: Neighbours that a block takes at most, and nodes that it has at least.
NEIGHBOURS, LEAST = 4, 3


def draw_blocks(edges: DataFrame, seed: int, neighbours: int = NEIGHBOURS, least: int = LEAST, eligible: DataFrame | None = None) -> DataFrame:
    """(seed, node, round): the nodes of each block, named by its seed node.

    ``edges`` (a, b) are undirected; ``eligible`` (node), if given, are the nodes that blocks may hold.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    if eligible is not None:
        for c in ("a", "b"):
            both = both.join(eligible.select(F.col("node").alias(c)).distinct(), c, "left_semi")
    free = written(both.select("a", "b"))
    drawn, turn = [], 0
    order = Window.partitionBy("a").orderBy("_h", "b")  # cut to a few rows a node before it shuffles
    while True:
        enough = free.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= least - 1).select("a")
        ranked = free.join(enough, "a", "left_semi").withColumn("_h", hashed(F.col("a"), F.col("b"), F.lit(seed)))
        taken = ranked.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= neighbours).select("a", F.col("b").alias("node"))
        rank = F.struct(hashed(F.col("a"), F.lit(seed)).alias("h"), "a")
        proposals = written(taken.union(taken.select("a", F.col("a").alias("node")).distinct()).withColumn("rank", rank))
        if proposals.isEmpty():
            break
        first = proposals.groupBy("node").agg(F.min("rank").alias("first"))
        got = proposals.join(first, "node").groupBy("a").agg(F.bool_and(F.col("rank") == F.col("first")).alias("all")).where("all").select("a")
        won = written(proposals.join(got, "a", "left_semi").select(F.col("a").alias("seed"), "node"))
        turn += 1
        drawn.append(won.withColumn("round", F.lit(turn)))
        for c in ("a", "b"):
            free = free.join(won.select(F.col("node").alias(c)), c, "left_anti")
        free = written(free.select("a", "b"))
    out = edges.select(F.col("a").alias("seed"), F.col("a").alias("node"), F.lit(0).alias("round")).where("false")
    for more in drawn:
        out = out.union(more)
    return out
