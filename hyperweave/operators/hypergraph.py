"""Operators over incidence tables (hg, e, v, ...): degrees, neighbourhoods, shells, components and colours.

All of them are joins and groupings on (hg, v) or (hg, e), so hypergraphs of a collection are worked on together
and a large one is spread over tasks. ``hg`` may be left out of an incidence table of a single hypergraph by
passing keys=().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.state import cut
from .components import linked

#: Rows of a table of links that any one task could hold, so hot keys need no care below it.
FEW = 1_000_000


def arity(inc: DataFrame, keys: tuple[str, ...] = ("hg",)) -> DataFrame:
    return inc.groupBy(*keys, "e").agg(F.count("*").alias("arity"))


def degree(inc: DataFrame, keys: tuple[str, ...] = ("hg",)) -> DataFrame:
    """Facts that each constant is in."""
    return inc.groupBy(*keys, "v").agg(F.count("*").alias("degree"))


def primal(inc: DataFrame, keys: tuple[str, ...] = ("hg",)) -> DataFrame:
    """Ordered pairs (v, w) of different constants that share a fact, each once."""
    left, right = inc.select(*keys, "e", "v"), inc.select(*keys, "e", F.col("v").alias("w"))
    return left.join(right, [*keys, "e"]).where("v <> w").select(*keys, "v", "w").distinct()


def ego(inc: DataFrame, chosen: DataFrame, keys: tuple[str, ...] = ("hg",)) -> DataFrame:
    """The incidences of the facts that hold a chosen constant (columns of keys and v)."""
    facts = inc.join(chosen, [*keys, "v"], "left_semi").select(*keys, "e").distinct()
    return inc.join(facts, [*keys, "e"], "left_semi")


def shells(inc: DataFrame, depth: int, keys: tuple[str, ...] = ("hg",)) -> DataFrame:
    """(keys, v, w, dist): constants within ``depth`` steps of each constant in the primal graph, 1 step at least.

    Each round joins the newest shell with the primal graph and keeps pairs not seen before.
    """
    edges = cut(primal(inc, keys))
    seen = new = edges.withColumn("dist", F.lit(1))
    for d in range(2, depth + 1):
        step = edges.select(*keys, F.col("v").alias("w"), F.col("w").alias("x"))
        new = new.join(step, [*keys, "w"]).select(*keys, "v", F.col("x").alias("w")).where("v <> w").distinct()
        new = cut(new.join(seen, [*keys, "v", "w"], "left_anti").withColumn("dist", F.lit(d)))
        seen = seen.union(new)
    return seen


def xi(inc: DataFrame, depth: int, keys: tuple[str, ...] = ("hg",)) -> DataFrame:
    """(keys, v, x1, ..): for each constant the number of constants at each distance up to ``depth``."""
    counts = [F.count_if(F.col("dist") == d).alias(f"x{d}") for d in range(1, depth + 1)]
    found = shells(inc, depth, keys).groupBy(*keys, "v").agg(*counts)
    every = inc.select(*keys, "v").distinct()
    return every.join(found, [*keys, "v"], "left").select(
        *keys, "v", *[F.coalesce(f"x{d}", F.lit(0)).alias(f"x{d}") for d in range(1, depth + 1)]
    )


def eta(inc: DataFrame, shape: DataFrame, keys: tuple[str, ...] = ("hg",)) -> DataFrame:
    """For each fact the sums of its members' ``xi``."""
    cols = [c for c in shape.columns if c not in (*keys, "v")]
    return inc.join(shape, [*keys, "v"]).groupBy(*keys, "e").agg(*[F.sum(c).alias(c) for c in cols])


def components(inc: DataFrame, keys: tuple[str, ...] = ("hg",)) -> DataFrame:
    """(keys, v, comp): the smallest constant that each constant reaches.

    The members of a fact are linked with its smallest, which gives the same components with few links.
    """
    least = inc.groupBy(*keys, "e").agg(F.min("v").alias("least"))
    links = inc.select(*keys, "e", "v").join(least, [*keys, "e"]).select(*keys, F.col("least").alias("u"), "v")
    found = linked(links, keys, FEW).select(*keys, F.col("node").alias("v"), "comp")
    every = inc.select(*keys, "v").distinct()
    return every.join(found, [*keys, "v"], "left").select(*keys, "v", F.coalesce("comp", "v").alias("comp"))


def refine(inc: DataFrame, rounds: int, colour: Column | None = None, keys: tuple[str, ...] = ("hg",)) -> DataFrame:
    """(keys, v, colour): colour refinement by rounds of sorted multisets, as digests that agree across hypergraphs.

    A fact's signature is its label (column pred, if any) and its members' sorted colours; a constant's new colour
    its old one and its facts' sorted signatures. Digests need no global ranking.
    """
    label = F.col("pred").cast("string") if "pred" in inc.columns else F.lit("")
    inc = cut(inc.select(*keys, "e", "v", label.alias("pred"), (F.lit("0") if colour is None else colour.cast("string")).alias("colour")))
    now = inc.groupBy(*keys, "v").agg(F.min("colour").alias("colour"))
    inc = inc.drop("colour")
    for _ in range(rounds):
        facts = inc.join(now, [*keys, "v"]).groupBy(*keys, "e", "pred").agg(F.sort_array(F.collect_list("colour")).alias("members"))
        facts = facts.select(*keys, "e", F.md5(F.concat_ws(",", F.col("pred"), F.array_join("members", ";"))).alias("sig"))
        sides = inc.join(facts, [*keys, "e"]).groupBy(*keys, "v").agg(F.sort_array(F.collect_list("sig")).alias("sigs"))
        now = cut(now.join(sides, [*keys, "v"]).select(*keys, "v", F.md5(F.concat_ws("|", "colour", F.array_join("sigs", ";"))).alias("colour")))
    return now


def compact(inc: DataFrame, keys: tuple[str, ...] = ("hg",)) -> DataFrame:
    """(keys, v, new_v): the constants in use numbered densely from 0 in their order, within each hypergraph."""
    order = Window.partitionBy(*keys).orderBy("v")
    return inc.select(*keys, "v").distinct().withColumn("new_v", F.row_number().over(order) - 1)


def summary(inc: DataFrame, keys: tuple[str, ...] = ("hg",)) -> DataFrame:
    """(keys, n, m, max_arity): constants, facts and the largest arity of each hypergraph."""
    facts = arity(inc, keys).groupBy(*keys).agg(F.count("*").alias("m"), F.max("arity").alias("max_arity"))
    return facts.join(inc.groupBy(*keys).agg(F.countDistinct("v").alias("n")), [*keys])


def admitted(shape: DataFrame) -> DataFrame:
    """The size window: at most 24 constants, 3 to 110 facts, arity at most 10."""
    return shape.where("n <= 24 AND m BETWEEN 3 AND 110 AND max_arity <= 10")
