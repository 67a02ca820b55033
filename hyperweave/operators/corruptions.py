"""Seeded corruptions of records with budgets: facts added, facts lost, arguments exchanged, and twins.

Draws are digests of the record, the attempt and what is drawn, so results don't depend on partitions. A draw that
would repeat a fact of its record is refused and the record's next attempt counts; records for which all attempts are
refused are left out, as are those that a corruption leaves isomorphic to what they were (without regard to labels).
Every function takes incidences (hg, e, v, and pred if facts have labels) and returns those of the corrupted records.
Records with a null id, and what else the incidences hold, take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.canonical import canonical_words
from ..functions.state import cut
from .statistics import hashed

#: Attempts of a record for each change, and swaps until a twin must differ.
ATTEMPTS, MOST_SWAPS = 20, 8


def facts_of(inc: DataFrame) -> DataFrame:
    """(hg, e, pred, m): facts with their sorted members; pred is empty where facts have no labels."""
    pred = F.coalesce(F.col("pred").cast("string"), F.lit("")) if "pred" in inc.columns else F.lit("")
    rows = inc.where("hg IS NOT NULL AND e IS NOT NULL AND v IS NOT NULL").select("hg", "e", "v", pred.alias("pred"))
    return rows.groupBy("hg", "e").agg(F.min("pred").alias("pred"), F.array_sort(F.collect_set("v")).alias("m"))


def incidences_of(facts: DataFrame) -> DataFrame:
    return facts.select("hg", "e", F.explode("m").alias("v"), "pred")


def _tries(rows: DataFrame, attempts: int) -> DataFrame:
    return rows.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(attempts))))


def _least(item: str, seed: int, *more: str) -> Column:
    """Of a record's rows in an attempt the one of the least digest of ``item``."""
    return F.min(F.struct(hashed(F.col("hg"), F.col("j"), F.col(item), F.lit(seed)).alias("h"), item, *more))


def _drawn(items: Column, seed: int) -> Column:
    """Of an array the element of the least digest, null if it is empty."""
    return F.array_min(F.transform(items, lambda x: F.struct(hashed(F.col("hg"), F.col("j"), x, F.lit(seed)).alias("h"), x.alias("x"))))["x"]


def spurious_facts(inc: DataFrame, budget: int, seed: int, attempts: int = ATTEMPTS) -> DataFrame:
    """``budget`` facts over a record's own constants that it doesn't hold, each of the label and arity of a drawn fact.

    New facts are numbered on from the record's last. Facts of one constant are drawn as pairs.
    """
    facts = cut(facts_of(inc))
    size = incidences_of(facts).groupBy("hg").agg(F.countDistinct("v").alias("n"), F.max("e").alias("last"))
    model = _tries(facts, attempts).groupBy("hg", "j").agg(_least("e", seed, "pred", "m").alias("f"))
    model = model.join(size.where("n > 1"), "hg").select("hg", "j", "last", "f.pred", F.greatest(F.lit(2), F.size("f.m")).alias("arity"))
    order = Window.partitionBy("hg", "j").orderBy(hashed(F.col("hg"), F.col("j"), F.col("v"), F.lit(seed + 1)), "v")
    constants = _tries(incidences_of(facts).select("hg", "v").distinct(), attempts).withColumn("r", F.row_number().over(order))
    drawn = constants.join(model, ["hg", "j"]).where("r <= arity").groupBy("hg", "j", "last", "pred").agg(F.array_sort(F.collect_list("v")).alias("m"))
    new = drawn.join(facts, ["hg", "pred", "m"], "left_anti").groupBy("hg", "pred", "m").agg(F.min("j").alias("j"), F.first("last").alias("last"))
    place = Window.partitionBy("hg").orderBy("j")
    kept = cut(new.withColumn("k", F.row_number().over(place)).where(F.col("k") <= budget))
    done = kept.where(F.col("k") == budget).select("hg")
    added = kept.select("hg", (F.col("last") + F.col("k")).cast(facts.schema["e"].dataType).alias("e"), "pred", "m")
    return incidences_of(facts.unionByName(added).join(done, "hg", "left_semi"))


def missing_facts(inc: DataFrame, budget: int, seed: int) -> DataFrame:
    """Records without ``budget`` drawn facts, of records that have more; constants of no other fact go with them."""
    facts = facts_of(inc)
    order = Window.partitionBy("hg").orderBy(hashed(F.col("hg"), F.col("e"), F.lit(seed)), "e")
    ranked = facts.withColumn("r", F.row_number().over(order))
    return incidences_of(ranked.where(F.col("r") > budget))


def _others(before: DataFrame, after: DataFrame) -> DataFrame:
    """The facts of ``after`` of records that are no longer isomorphic to those of ``before``."""
    word = lambda facts, name: canonical_words(incidences_of(facts)).select("hg", F.col("word").alias(name))
    old = word(before.join(after.select("hg").distinct(), "hg", "left_semi"), "old")
    # A search that gave up has no word: such a record can't be verified and is left out.
    return after.join(word(after, "new").join(old, "hg").where("new <> old").select("hg"), "hg", "left_semi")


def _first_valid(facts: DataFrame, changes: DataFrame) -> DataFrame:
    """Of changes (hg, j, new: array of (e, pred, m)) the first of each record that repeats no fact of it."""
    made = changes.select("hg", "j", F.explode("new").alias("f")).select("hg", "j", "f.*")
    refused = made.join(facts.select("hg", "pred", "m"), ["hg", "pred", "m"], "left_semi").select("hg", "j").distinct()
    good = changes.join(refused, ["hg", "j"], "left_anti")
    return good.groupBy("hg").agg(F.min_by("new", "j").alias("new"))


def _changed(facts: DataFrame, chosen: DataFrame) -> DataFrame:
    """The facts of the records of ``chosen``, with its new facts in the place of those of the same numbers."""
    new = chosen.select("hg", F.explode("new").alias("f")).select("hg", F.col("f.e").alias("e"), F.col("f.m").alias("to"))
    own = facts.join(chosen.select("hg"), "hg", "left_semi")
    return own.join(new, ["hg", "e"], "left").select("hg", "e", "pred", F.coalesce("to", "m").alias("m"))


def _exchanged(items: Column, old: Column, new: Column) -> Column:
    return F.array_sort(F.array_union(F.array_except(items, F.array(old)), F.array(new)))


def wrong_arguments(inc: DataFrame, budget: int, seed: int, attempts: int = ATTEMPTS) -> DataFrame:
    """``budget`` times one member of a drawn fact becomes another constant of the record, a change after the other."""
    facts = before = cut(facts_of(inc))
    for step in range(budget):
        own = seed + 10 * step
        drawn = _tries(facts, attempts).groupBy("hg", "j").agg(_least("e", own, "pred", "m").alias("f"))
        # The entrant is a member of some drawn fact; one that is in the changed fact already refuses the attempt.
        entrant = _tries(incidences_of(before).select("hg", "v").distinct(), attempts).groupBy("hg", "j").agg(_least("v", own + 1).alias("w"))
        both = drawn.join(entrant, ["hg", "j"]).select("hg", "j", "f.e", "f.pred", "f.m", F.col("w.v").alias("new"))
        both = both.where(~F.array_contains("m", F.col("new"))).withColumn("old", _drawn(F.col("m"), own + 2))
        made = both.select("hg", "j", F.array(F.struct("e", "pred", _exchanged(F.col("m"), F.col("old"), F.col("new")).alias("m"))).alias("new"))
        facts = cut(_changed(facts, _first_valid(facts, made)))
    return incidences_of(_others(before, facts))


def iso_twins(inc: DataFrame, seed: int, attempts: int = ATTEMPTS, most_swaps: int = MOST_SWAPS) -> DataFrame:
    """(hg, e, v, pred, swaps): two facts exchange a member each, until a record is not isomorphic to what it was.

    Sizes, arities, degrees and labels stay as they were. Records whose swaps are all refused, or that stay isomorphic
    over ``most_swaps`` of them, are left out.
    """
    facts = before = cut(facts_of(inc))
    found = [incidences_of(before.limit(0)).withColumn("swaps", F.lit(0))]
    for step in range(1, most_swaps + 1):
        own = seed + 10 * step
        drawn = _tries(facts, attempts).groupBy("hg", "j").agg(_least("e", own, "pred", "m").alias("a"), _least("e", own + 1, "pred", "m").alias("b"))
        drawn = drawn.where("a.e <> b.e")
        out, into = _drawn(F.array_except("a.m", "b.m"), own + 2), _drawn(F.array_except("b.m", "a.m"), own + 3)
        drawn = drawn.withColumn("x", out).withColumn("y", into).where("x IS NOT NULL AND y IS NOT NULL")
        side = lambda s, old, new: F.struct(F.col(f"{s}.e").alias("e"), F.col(f"{s}.pred").alias("pred"), _exchanged(F.col(f"{s}.m"), F.col(old), F.col(new)).alias("m"))
        made = drawn.select("hg", "j", F.array(side("a", "x", "y"), side("b", "y", "x")).alias("new"))
        swapped = cut(_changed(facts, _first_valid(facts, made)))
        apart = cut(_others(before, swapped))
        found.append(incidences_of(apart).withColumn("swaps", F.lit(step)))
        facts = cut(swapped.join(apart.select("hg").distinct(), "hg", "left_anti"))
        if facts.isEmpty():
            break
    return reduce(DataFrame.union, found)
