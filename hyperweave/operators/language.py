"""Reach and consensus of records up to isomorphism, by canonical words of what deletions leave."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.canonical import canonical_word
from ..functions.state import cut
from .edits import subsets


def remainders(records: DataFrame, most: int) -> DataFrame:
    """(rec, dels, word): canonical words of each record less up to ``most`` facts, with the fewest deletions.

    ``records`` has rec and facts (array of arrays of constants). Constants that no fact is left for go. What the
    search for a word gives up on has a word of its own, which no other record shares.
    """
    places = records.select("rec", "facts", F.sequence(F.lit(1), F.size("facts")).alias("all"))
    less = subsets(places, "all", most).select("rec", F.size("subset").alias("dels"), "facts", "subset")
    left = F.filter("facts", lambda f, i: ~F.array_contains(F.col("subset"), i + 1))
    rows = less.select("rec", "dels", F.array_sort(left).alias("facts")).groupBy("rec", "facts").agg(F.min("dels").alias("dels"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for rec, facts in zip(f["rec"], f["facts"]):
                names: dict = {}
                own = [(0, tuple(sorted(names.setdefault(v, len(names)) for v in m))) for m in facts]
                out.append(canonical_word([0] * len(names), own) or (f"censored {rec} {own}" if own else ""))
            yield pd.DataFrame({"rec": f["rec"], "dels": f["dels"], "word": out})

    named = rows.mapInPandas(work, "rec long, dels int, word string")
    return named.groupBy("rec", "word").agg(F.min("dels").alias("dels"))


def reach(left: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """(a, b, reach): the fewest deletions on both sides that leave isomorphic records, null beyond ``most``.

    ``left`` is the result of ``remainders``; a pair meets by its common words only.
    """
    x = left.select(F.col("rec").alias("a"), "word", F.col("dels").alias("da"))
    y = left.select(F.col("rec").alias("b"), "word", F.col("dels").alias("db"))
    total = F.col("da") + F.col("db")
    found = pairs.join(x, "a").join(y, ["b", "word"]).where(total <= most).groupBy("a", "b").agg(F.min(total).alias("reach"))
    return pairs.join(found, ["a", "b"], "left").select("a", "b", "reach")


def consensus(members: DataFrame, left: DataFrame, radius: int) -> DataFrame:
    """(grp, rec, coverage, total): for each group the member within ``radius`` of most members.

    ``members`` has grp and rec. Ties go to the least sum of min(reach, radius + 1), then to the least word.
    Members of a group with the same word are one class with a count, so equal members are never paired.
    """
    whole = left.where("dels = 0").select("rec", "word")
    classes = members.join(whole, "rec").groupBy("grp", "word").agg(F.min("rec").alias("rec"), F.count("*").alias("n"))
    classes = cut(classes)
    parts = classes.select("grp", F.col("rec").alias("c"), "n").join(left, F.col("c") == left.rec).select("grp", "c", "n", "word", "dels")
    mine = parts.select("grp", "word", F.col("c").alias("a"), F.col("dels").alias("da"))
    other = parts.select("grp", "word", F.col("c").alias("b"), F.col("dels").alias("db"), F.col("n").alias("nb"))
    total = F.col("da") + F.col("db")
    near = mine.join(other, ["grp", "word"]).where(total <= radius).groupBy("grp", "a", "b").agg(F.min(total).alias("r"), F.first("nb").alias("nb"))
    sizes = classes.groupBy("grp").agg(F.sum("n").alias("size"))
    score = near.groupBy("grp", "a").agg(F.sum("nb").alias("coverage"), F.sum(F.col("nb") * F.col("r")).alias("inside")).join(sizes, "grp")
    score = score.withColumn("total", F.col("inside") + (radius + 1) * (F.col("size") - F.col("coverage")))
    ranked = score.join(classes.select(F.col("rec").alias("a"), "grp", "word"), ["grp", "a"])
    order = Window.partitionBy("grp").orderBy(F.desc("coverage"), "total", "word")
    best = ranked.withColumn("k", F.row_number().over(order)).where("k = 1")
    return best.select("grp", F.col("a").alias("rec"), "coverage", "total")
