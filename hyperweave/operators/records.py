"""Operators over records: vocabularies, keys, invariants, quantiles, majorities and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.state import numbered, running


def vocabulary(symbols: DataFrame) -> DataFrame:
    """(kind, name, id): the distinct symbols of each kind numbered from 0 in their order."""
    return numbered(symbols.select("kind", "name").distinct(), ["kind"], ["name"], "id")


def fact_keys(inc: DataFrame) -> DataFrame:
    """(hg, key): the sorted set of facts of each hypergraph, a fact being its sorted constants."""
    facts = inc.groupBy("hg", "e").agg(F.array_join(F.sort_array(F.collect_list("v")), ",").alias("f"))
    return facts.groupBy("hg").agg(F.array_join(F.sort_array(F.collect_set("f")), ";").alias("key"))


def invariants(inc: DataFrame) -> DataFrame:
    """(hg, invariant): sorted degrees and sorted arities."""
    text = lambda c: F.array_join(F.sort_array(F.collect_list(c)), ",")
    degrees = inc.groupBy("hg", "v").agg(F.count("*").alias("d")).groupBy("hg").agg(text("d").alias("ds"))
    arities = inc.groupBy("hg", "e").agg(F.count("*").alias("a")).groupBy("hg").agg(text("a").alias("arities"))
    return degrees.join(arities, "hg").select("hg", F.concat_ws("/", "ds", "arities").alias("invariant"))


def nearest_rank(df: DataFrame, col: str, shares: list[float]) -> DataFrame:
    """(p, col): the value at rank round(p (n-1)), halves to even, without interpolation.

    Values are counted first, then the counts are summed up in order, so ties cost nothing.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    upto = running(counts, [col], {"_upto": "_n"})
    ranks = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(round(p * (total - 1))).alias("at")) for p in shares])
    wanted = upto.withColumn("w", F.explode(ranks))
    return wanted.where((F.col("w.at") < F.col("_upto")) & (F.col("w.at") >= F.col("_upto") - F.col("_n"))).select("w.p", col)


def majority(df: DataFrame, group: str, member: str, fact: str) -> DataFrame:
    """(group, fact, asserted, members): facts that strictly more than half of a group's members assert."""
    members = df.groupBy(group).agg(F.countDistinct(member).alias("members"))
    asserted = df.groupBy(group, fact).agg(F.countDistinct(member).alias("asserted"))
    return asserted.join(members, group).where("2 * asserted > members")


def cooccurrence(df: DataFrame) -> DataFrame:
    """(pattern, other, together): records (hg) that hold both of two patterns."""
    own = df.select("hg", "pattern").distinct()
    other = own.select("hg", F.col("pattern").alias("other"))
    return own.join(other, "hg").where("pattern < other").groupBy("pattern", "other").agg(F.count("*").alias("together"))
