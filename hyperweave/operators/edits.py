"""Edits of hypergraphs in long form, and the records one step below a record.

Each function takes and returns incidence tables (hg, e, v); edits are tables too, one row an edit, so a whole
collection is edited in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .hypergraph import components
from .statistics import hashed


def insert_facts(inc: DataFrame, facts: DataFrame) -> DataFrame:
    """Add facts (hg, members array) under new fact numbers; facts that are there already are left out."""
    have = inc.groupBy("hg", "e").agg(F.sort_array(F.collect_list("v")).alias("members")).select("hg", "members")
    fresh = facts.select("hg", F.array_sort(F.array_distinct("members")).alias("members")).distinct().join(have, ["hg", "members"], "left_anti")
    last = inc.groupBy("hg").agg(F.max("e").alias("last"))
    order = Window.partitionBy("hg").orderBy("members")
    numbered = fresh.join(last, "hg", "left").withColumn("e", F.coalesce("last", F.lit(-1)) + F.row_number().over(order))
    return inc.select("hg", "e", "v").union(numbered.select("hg", "e", F.explode("members").alias("v")))


def delete_facts(inc: DataFrame, facts: DataFrame) -> DataFrame:
    """Remove facts (hg, e) and number the rest densely in their order."""
    left = inc.join(facts, ["hg", "e"], "left_anti")
    order = Window.partitionBy("hg").orderBy("e")
    return left.select("hg", (F.dense_rank().over(order) - 1).alias("e"), "v")


def delete_constants(inc: DataFrame, constants: DataFrame) -> DataFrame:
    """Remove constants (hg, v) from every fact; facts left without any go."""
    return inc.join(constants, ["hg", "v"], "left_anti").select("hg", "e", "v")


def add_incidences(inc: DataFrame, pairs: DataFrame) -> DataFrame:
    return inc.select("hg", "e", "v").union(pairs.select("hg", "e", "v")).distinct()


def remove_incidences(inc: DataFrame, pairs: DataFrame) -> DataFrame:
    return inc.select("hg", "e", "v").join(pairs, ["hg", "e", "v"], "left_anti")


def swap_incidences(inc: DataFrame, swaps: DataFrame) -> DataFrame:
    """Exchange v1 of e1 with v2 of e2 (hg, e1, v1, e2, v2): degrees and arities stay. Invalid swaps change nothing.

    A swap is valid if v1 isn't in e2 and v2 isn't in e1.
    """
    has = lambda e, v: inc.select("hg", F.col("e").alias(e), F.col("v").alias(v))
    fine = swaps.join(has("e1", "v1"), ["hg", "e1", "v1"], "left_semi").join(has("e2", "v2"), ["hg", "e2", "v2"], "left_semi")
    fine = fine.join(has("e2", "v1"), ["hg", "e2", "v1"], "left_anti").join(has("e1", "v2"), ["hg", "e1", "v2"], "left_anti")
    one = lambda e, v, new: fine.select("hg", F.col(e).alias("e"), F.col(v).alias("v"), F.col(new).alias("new"))
    moves = one("e1", "v1", "v2").union(one("e2", "v2", "v1"))
    return inc.select("hg", "e", "v").join(moves, ["hg", "e", "v"], "left").select("hg", "e", F.coalesce("new", "v").alias("v"))


def permute(inc: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rename constants by a bijection (hg, v, w)."""
    return inc.join(mapping, ["hg", "v"]).select("hg", "e", F.col("w").alias("v"))


def anonymise(inc: DataFrame, seed: int) -> DataFrame:
    """Constants numbered in a seeded order of their hashes."""
    order = Window.partitionBy("hg").orderBy(F.xxhash64("hg", "v", F.lit(seed)), "v")
    return permute(inc, inc.select("hg", "v").distinct().withColumn("w", F.row_number().over(order) - 1))


def down_neighbours(inc: DataFrame, least_arity: int = 2) -> DataFrame:
    """(hg, kind, e, v): the single down-edits of each record: drop a fact, or one constant of a fact large enough."""
    sizes = inc.groupBy("hg", "e").agg(F.count("*").alias("arity"))
    facts = sizes.select("hg", F.lit("fact").alias("kind"), "e", F.lit(None).cast(inc.schema["v"].dataType).alias("v"))
    wide = sizes.where(F.col("arity") > least_arity).select("hg", "e")
    return facts.union(inc.join(wide, ["hg", "e"], "left_semi").select("hg", F.lit("constant"), "e", "v"))


def edit_cost(kind: str, arity: str):
    """A fact inserted or deleted costs its arity plus one, any other edit one."""
    return F.when(F.col(kind) == "fact", F.col(arity) + 1).otherwise(1)


def _picked(rows: DataFrame, item: str, seed: int) -> DataFrame:
    """(hg, item): for each record the item of the least seeded digest."""
    place = F.struct(hashed(F.col("hg"), F.col(item), F.lit(seed)).alias("h"), item)
    return rows.groupBy("hg").agg(F.min(place).alias("b")).select("hg", F.col(f"b.{item}").alias(item))


def drop_picked_facts(inc: DataFrame, seed: int) -> DataFrame:
    """A missing fact in each record that has others: which one, a seeded digest says."""
    return inc.select("hg", "e", "v").join(_fact_of_many(inc, seed), ["hg", "e"], "left_anti")


def _fact_of_many(inc: DataFrame, seed: int) -> DataFrame:
    many = inc.groupBy("hg").agg(F.countDistinct("e").alias("m")).where("m > 1").select("hg")
    return _picked(inc.join(many, "hg", "left_semi"), "e", seed)


def exchange_picked_argument(inc: DataFrame, seed: int) -> DataFrame:
    """A wrong argument in each record: one member of a picked fact becomes a constant of the record from outside it."""
    inc = inc.select("hg", "e", "v")
    fact = _fact_of_many(inc, seed)
    members = inc.join(fact, ["hg", "e"], "left_semi")
    old = fact.join(_picked(members, "v", seed + 1), "hg")
    others = inc.join(fact.select("hg"), "hg", "left_semi").join(members.select("hg", "v"), ["hg", "v"], "left_anti")
    new = _picked(others, "v", seed + 2).withColumnRenamed("v", "w")
    swaps = old.join(new, "hg")
    return inc.join(swaps, ["hg", "e", "v"], "left").select("hg", "e", F.coalesce("w", "v").alias("v"))


def verdicts(inc: DataFrame) -> DataFrame:
    """(hg, facts, kept, verdict): records with a fact of one constant or in several components are rejected."""
    sizes = inc.groupBy("hg", "e").agg(F.count("*").alias("a"), F.array_join(F.sort_array(F.collect_list("v")), ",").alias("f"))
    shape = sizes.groupBy("hg").agg(F.min("a").alias("least"), F.count("*").alias("facts"), F.countDistinct("f").alias("kept"))
    parts = components(inc).groupBy("hg").agg(F.countDistinct("comp").alias("parts"))
    verdict = F.when(F.col("least") < 2, "unary").when(F.col("parts") > 1, "disconnected").otherwise("accepted")
    return shape.join(parts, "hg").select("hg", "facts", "kept", verdict.alias("verdict"))


def subsets(df: DataFrame, items: str, most: int) -> DataFrame:
    """``df`` with each subset of up to ``most`` elements of an array column, as ``subset``."""
    out = df.withColumn("subset", F.array().cast(df.schema[items].dataType))
    level = out.withColumn("_next", F.lit(1))
    for _ in range(most):
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1))), lambda k: (k >= F.col("_next")) & (k <= F.size(items)))
        level = level.withColumn("_at", F.explode(places))
        level = level.withColumn("subset", F.array_append("subset", F.element_at(items, F.col("_at")))).withColumn("_next", F.col("_at") + 1).drop("_at")
        out = out.union(level.drop("_next"))
    return out


def reach(facts: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """(a, b, reach): the fewest deletions on both sides that leave equal fact sets, null beyond ``most``.

    ``facts`` has hg and an array of facts by identity; then the fewest is the symmetric difference, which never
    needs more than one pass over the two arrays.
    """
    x, y = facts.select(F.col("hg").alias("a"), F.col("facts").alias("fa")), facts.select(F.col("hg").alias("b"), F.col("facts").alias("fb"))
    both = pairs.join(x, "a").join(y, "b")
    apart = F.size(F.array_except("fa", "fb")) + F.size(F.array_except("fb", "fa"))
    return both.select("a", "b", F.when(apart <= most, apart).alias("reach"))
