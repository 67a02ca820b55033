"""Ladders of edits: each rung is the one before with a fact more or less, over the same constants and connected.

All records climb together, a rung a round. A record's attempts of a round are drawn by digests, checked at once (facts
that are there already by an anti-join, constants left over by a count, connection by components of all attempts), and
the first good one is the rung; a record without one climbs no further.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.state import cut
from .corruptions import _least, _tries, facts_of, incidences_of
from .hypergraph import components
from .statistics import hashed

#: Attempts of a record for each rung.
ATTEMPTS = 6


def _inserts(facts: DataFrame, known: DataFrame, seed: int, attempts: int) -> DataFrame:
    """(hg, j, e, pred, m): facts that could be added, of the label and arity of a drawn one, none of them known."""
    own = incidences_of(facts)
    model = _tries(facts, attempts).groupBy("hg", "j").agg(_least("e", seed + 1, "pred", "m").alias("f"))
    model = model.join(facts.groupBy("hg").agg(F.max("top").alias("top")), "hg")
    model = model.select("hg", "j", F.col("top").alias("e"), "f.pred", F.greatest(F.lit(2), F.size("f.m")).alias("arity"))
    order = Window.partitionBy("hg", "j").orderBy(hashed(F.col("hg"), F.col("j"), F.col("v"), F.lit(seed + 2)), "v")
    constants = _tries(own.select("hg", "v").distinct(), attempts).withColumn("r", F.row_number().over(order))
    drawn = constants.join(model, ["hg", "j"]).where("r <= arity").groupBy("hg", "j", "e", "pred").agg(F.array_sort(F.collect_list("v")).alias("m"))
    return drawn.where(F.size("m") > 1).join(known, ["hg", "pred", "m"], "left_anti")


def ladder(inc: DataFrame, rungs: int, seed: int, attempts: int = ATTEMPTS) -> DataFrame:
    """(hg, t, e, v, pred, op, delta): the rungs t = 1 to ``rungs`` that each record reaches, op is that of the rung.

    Rungs lead away from the record: only facts of its own go, and only facts that it never held come, so ``delta``, the
    facts in which a rung and the record differ, is t. Facts come and go by an even draw; new ones are numbered on.
    Records that are not connected reach a rung only where a new fact connects them.
    """
    facts = facts_of(inc).withColumn("own", F.lit(True))
    facts = before = cut(facts.join(facts.groupBy("hg").agg((F.max("e") + 1).alias("top")), "hg"))
    constants = before.select("hg", F.explode("m").alias("v")).groupBy("hg").agg(F.countDistinct("v").alias("n"))
    base = before.select("hg", "pred", "m")
    columns = ["hg", "e", "pred", "m", "own", "top"]
    found = []
    for t in range(1, rungs + 1):
        at = seed + 10 * t
        come = hashed(F.col("hg"), F.col("j"), F.lit(at)) % 2 == 0
        known = facts.select("hg", "pred", "m").unionByName(base)
        added = _inserts(facts, known, at, attempts).where(come)
        gone = _tries(facts.where("own"), attempts).groupBy("hg", "j").agg(_least("e", at + 3).alias("f")).where(~come).select("hg", "j", F.col("f.e").alias("gone"))
        stay = _tries(facts, attempts)
        less = stay.join(gone, ["hg", "j"]).where("e <> gone").select(*columns, "j", F.lit("del").alias("op"))
        more = stay.join(added.select("hg", "j"), ["hg", "j"], "left_semi").select(*columns, "j", F.lit("ins").alias("op"))
        new = added.select("hg", "e", "pred", "m", F.lit(False).alias("own"), (F.col("e") + 1).alias("top"), "j", F.lit("ins").alias("op"))
        tried = cut(less.unionByName(more).unionByName(new))
        sides = tried.select("hg", "j", "e", F.explode("m").alias("v"))
        whole = sides.groupBy("hg", "j").agg(F.countDistinct("v").alias("n")).join(constants, ["hg", "n"], "left_semi")
        parts = components(sides.join(whole, ["hg", "j"], "left_semi"), ("hg", "j")).groupBy("hg", "j").agg(F.countDistinct("comp").alias("parts"))
        first = parts.where("parts = 1").groupBy("hg").agg(F.min("j").alias("j"))
        chosen = tried.join(first, ["hg", "j"])
        tops = chosen.groupBy("hg").agg(F.max("top").alias("top"))
        rung = cut(chosen.drop("top", "j").join(tops, "hg"))
        kept = rung.groupBy("hg").agg(F.count_if("own").alias("kept"), F.count_if(~F.col("own")).alias("new"))
        delta = kept.join(before.groupBy("hg").agg(F.count("*").alias("m")), "hg").select("hg", (F.col("m") - F.col("kept") + F.col("new")).alias("delta"))
        rows = rung.join(delta, "hg").select("hg", F.lit(t).alias("t"), "e", F.explode("m").alias("v"), "pred", "op", "delta")
        found.append(rows)
        facts = rung.select(*columns)
    return reduce(DataFrame.union, found)
