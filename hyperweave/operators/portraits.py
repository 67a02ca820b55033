"""Portraits of hypergraphs: how many facts of each size lie at each distance of facts of each size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.state import hot_keys, look_up, numbered, written
from .hypergraph import arity
from .neighbours import compared_all


def fact_distances(inc: DataFrame) -> DataFrame:
    """(hg, e, f, l): steps between every two facts of a hypergraph that chains of shared constants connect.

    Each round takes the newest pairs one step on and keeps what was not seen before, until nothing is new. A fact
    is at distance 0 of itself; pairs that nothing connects have no row.
    """
    one, two = inc.select("hg", "v", "e"), inc.select("hg", "v", F.col("e").alias("f"))
    steps = written(one.join(two, ["hg", "v"]).where("e <> f").select("hg", "e", "f").distinct())
    seen = inc.select("hg", "e", F.col("e").alias("f")).distinct().withColumn("l", F.lit(0))
    new, depth = steps.withColumn("l", F.lit(1)), 1
    on = steps.select("hg", F.col("e").alias("f"), F.col("f").alias("g"))
    while not new.isEmpty():
        seen, depth = written(seen.union(new)), depth + 1
        reached = new.join(on, ["hg", "f"]).select("hg", "e", F.col("g").alias("f")).distinct()
        new = written(reached.join(seen, ["hg", "e", "f"], "left_anti").withColumn("l", F.lit(depth)))
    return seen


def portrait(inc: DataFrame) -> DataFrame:
    """(hg, m, n, l, k, times): how many facts of size m have k facts of size n at distance l.

    Sizes go from 2 to the hypergraph's largest and distances from 0 to its longest, so k = 0 is counted too: those
    rows are what the other facts of that size leave. Facts of one constant are left out.
    """
    sizes = arity(inc).where("arity > 1")
    far = fact_distances(inc.join(sizes.select("hg", "e"), ["hg", "e"], "left_semi"))
    own, other = sizes.select("hg", "e", F.col("arity").alias("m")), sizes.select("hg", F.col("e").alias("f"), F.col("arity").alias("n"))
    counts = far.join(own, ["hg", "e"]).join(other, ["hg", "f"]).groupBy("hg", "e", "m", "n", "l").agg(F.count("*").alias("k"))
    met = counts.groupBy("hg", "m", "n", "l", "k").agg(F.count("*").alias("times"))
    # What is met nowhere: every size and distance of the hypergraph, less the facts that meet something there.
    ends = far.groupBy("hg").agg(F.max("l").alias("longest")).join(sizes.groupBy("hg").agg(F.max("arity").alias("largest")), "hg")
    grid = sizes.groupBy("hg", F.col("arity").alias("m")).agg(F.count("*").alias("facts")).join(ends, "hg")
    grid = grid.withColumn("n", F.explode(F.sequence(F.lit(2).cast("long"), "largest"))).withColumn("l", F.explode(F.sequence(F.lit(0), "longest")))
    some = met.groupBy("hg", "m", "n", "l").agg(F.sum("times").alias("some"))
    rest = F.col("facts") - F.coalesce("some", F.lit(0))
    none = grid.join(some, ["hg", "m", "n", "l"], "left").select("hg", "m", "n", "l", F.lit(0).cast("long").alias("k"), rest.alias("times"))
    return met.unionByName(none.where("times > 0"))


def portrait_divergence(portraits: DataFrame) -> DataFrame:
    """(i, j, divergence): Jensen-Shannon divergence in bits of query hypergraphs' portraits and all others'.

    Only entries that both have need work: what one alone has adds half its share, so a pair without common entries is
    at 1. Entries are numbered, and each pair compares two maps of numbers where it is: entries that all hypergraphs
    have are dealt out to no single task.
    """
    total = portraits.groupBy("hg").agg(F.sum("times").alias("t"))
    cell = F.concat_ws("-", "m", "n", "l", "k").alias("cell")
    share = written(portraits.join(total, "hg").select("hg", cell, (F.col("times") / F.col("t")).alias("p")))
    known = numbered(share.select("cell").distinct(), [], ["cell"], "c").select("cell", "c")
    coded = look_up(share, ["cell"], known, hot_keys(share, ["cell"]))
    maps = coded.groupBy("hg").agg(F.map_from_entries(F.collect_list(F.struct("c", "p"))).alias("h"))
    x, y = (lambda k: F.col("q.h")[k]), (lambda k: F.col("x.h")[k])
    half = lambda u, k: u(k) * (F.log2(2 * u(k) / (x(k) + y(k))) - 1)
    common = F.array_intersect(F.map_keys("q.h"), F.map_keys("x.h"))
    sums = F.aggregate(common, F.lit(0.0), lambda done, k: done + half(x, k) + half(y, k))
    return compared_all(maps, "hg", divergence=F.greatest(1 + sums / 2, F.lit(0.0)))
