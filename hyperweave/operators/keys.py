"""Local keys, addresses, alphabets and code lengths of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.state import numbered
from .hypergraph import arity, components, degree


def local_keys(inc: DataFrame) -> DataFrame:
    """(hg, v, key): the sorted labels and arities of each constant's facts."""
    sized = inc.join(arity(inc), ["hg", "e"])
    item = F.concat_ws(":", "pred", F.col("arity").cast("string"))
    return sized.groupBy("hg", "v").agg(F.array_join(F.sort_array(F.collect_list(item)), ",").alias("key"))


def addresses(keys: DataFrame) -> DataFrame:
    """(hg, v, key, place): each constant's place among those of its record with the same key."""
    order = Window.partitionBy("hg", "key").orderBy("v")
    return keys.withColumn("place", F.row_number().over(order) - 1)


def root(inc: DataFrame) -> DataFrame:
    """(hg, root, degree): the constant of the highest degree, the smallest among equals."""
    best = degree(inc).groupBy("hg").agg(F.min(F.struct((-F.col("degree")).alias("d"), "v")).alias("b"))
    return best.select("hg", F.col("b.v").alias("root"), (-F.col("b.d")).alias("degree"))


def interior_facts(inc: DataFrame) -> DataFrame:
    """(hg, e): facts that share a constant other than the root with another fact."""
    others = inc.join(root(inc), "hg").where("v <> root").select("hg", "e", "v")
    shared = others.groupBy("hg", "v").agg(F.count("*").alias("n")).where("n > 1")
    return others.join(shared, ["hg", "v"], "left_semi").select("hg", "e").distinct()


def largest_component(inc: DataFrame) -> DataFrame:
    """The incidences of each record's largest component, the one with the smallest constant among equals."""
    comp = components(inc)
    sizes = comp.groupBy("hg", "comp").agg(F.count("*").alias("n"))
    best = sizes.groupBy("hg").agg(F.min(F.struct((-F.col("n")).alias("n"), "comp")).alias("b")).select("hg", "b.comp")
    return inc.join(comp.join(best, ["hg", "comp"], "left_semi").select("hg", "v"), ["hg", "v"], "left_semi")


def frequency_ids(df: DataFrame, col: str) -> DataFrame:
    """(col, times, id): values numbered from 0 by falling frequency, ties by value."""
    counts = df.groupBy(col).agg(F.count("*").alias("times"))
    return numbered(counts.withColumn("_down", -F.col("times")), [], ["_down", col], "id").drop("_down")


def code_bits(inc: DataFrame) -> DataFrame:
    """(hg, bits): fixed-width code length of an incidence list: each member by log2 n, each fact's size by log2 (largest + 1)."""
    facts = arity(inc)
    top = facts.groupBy("hg").agg(F.count("*").alias("m"), F.max("arity").alias("top"), F.sum("arity").alias("i"))
    size = inc.groupBy("hg").agg(F.countDistinct("v").alias("n"))
    return top.join(size, "hg").select("hg", (F.col("i") * F.log2("n") + F.col("m") * F.log2(F.col("top") + 1)).alias("bits"))


def pattern_vote(items: DataFrame) -> DataFrame:
    """(grp, pattern, copies): the most copies of a pattern that strictly more than half of a group's members carry.

    ``items`` has grp, member and pattern, one row for each copy.
    """
    members = items.groupBy("grp").agg(F.countDistinct("member").alias("members"))
    counts = items.groupBy("grp", "member", "pattern").agg(F.count("*").alias("c")).groupBy("grp", "pattern", "c").agg(F.count("*").alias("n"))
    order = Window.partitionBy("grp", "pattern").orderBy(F.desc("c"))
    carried = counts.withColumn("have", F.sum("n").over(order)).join(members, "grp").where("2 * have > members")
    return carried.groupBy("grp", "pattern").agg(F.max("c").alias("copies"))


def prefer(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in ``order``: merging runs by preference of their source."""
    best = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")
