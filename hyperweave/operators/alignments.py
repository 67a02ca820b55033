"""Witnesses of isomorphism as rows: certificates of classes, alignments of records after deletions, and their checks.

A record is a row (rec, facts), its facts distinct sorted arrays of constants. The search gives each record a canonical
word and its constants in the order of their ranks; records of one word are isomorphic, and the constants of equal rank
correspond. Nothing is taken on trust: a witness is verified by joining the mapped facts with the facts that they should
be, in both directions, so an error of the search would show.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.canonical import MAX_LEAVES, canonical_form
from ..functions.state import written
from .edits import subsets


def forms(records: DataFrame, max_leaves: int = MAX_LEAVES) -> DataFrame:
    """``records`` (with ``facts``) with ``word`` and ``named``: the canonical word, and the constants by rank.

    A record that the search gives up on has no word (null). The record without facts has the empty word.
    """
    kind = records.schema["facts"].dataType.elementType.elementType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out, named = [], []
            for facts in f["facts"]:
                ids: dict = {}
                own = [(0, tuple(sorted(ids.setdefault(v, len(ids)) for v in m))) for m in facts]
                word, ranks = canonical_form([0] * len(ids), own, max_leaves)
                constants = list(ids)
                out.append(word)
                named.append([constants[k] for k in sorted(range(len(ranks)), key=ranks.__getitem__)])
            yield f.assign(word=out, named=named)

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in records.schema)
    return records.mapInPandas(run, f"{schema}, word string, named array<{kind}>")


def certificates(named: DataFrame) -> DataFrame:
    """(rec, first, map): for each record (rec, facts, word, named) the least record of its class, and the constants of
    it (``w``) that its own (``v``) correspond to. Records without a word stand alone."""
    first = named.where("word is not null").groupBy("word").agg(F.min(F.struct("rec", "named")).alias("f"))
    both = named.where("word is not null").select("rec", "word", "named").join(first, "word")
    pairs = lambda a, b: F.arrays_zip(a.alias("v"), b.alias("w"))
    found = both.select("rec", F.col("f.rec").alias("first"), pairs(F.col("named"), F.col("f.named")).alias("map"))
    alone = named.where("word is null")
    every = F.array_sort(F.array_distinct(F.flatten("facts")))
    return found.union(alone.select("rec", F.col("rec").alias("first"), F.transform(every, lambda v: F.struct(v.alias("v"), v.alias("w")))))


def carried(facts: str | Column, pairs: str | Column) -> Column:
    """The facts with every constant exchanged for its image, in order; a constant without an image becomes null."""
    images = F.map_from_entries(pairs)
    return F.array_sort(F.transform(facts, lambda m: F.array_sort(F.transform(m, lambda v: images[v]))))


def verified(witnesses: DataFrame, records: DataFrame, left: str = "rec", right: str = "first") -> DataFrame:
    """``witnesses`` (left, right, map) with ``verified``: the map is one to one, onto all constants of the right record, and
    takes the left record's facts to the right one's, none more and none less.

    Facts meet by joins in both directions: each mapped fact must be one of the right record, and each fact of that must
    be a mapped one.
    """
    w = witnesses.withColumn("_w", F.monotonically_increasing_id())
    w = written(w)
    facts = records.select(F.col("rec").alias("_r"), F.explode("facts").alias("_f"))
    images = F.map_from_entries("map")
    moved = w.select("_w", "map", F.col(left).alias("_r"), F.col(right).alias("_to")).join(facts, "_r")
    moved = moved.select("_w", F.col("_to").alias("_r"), F.array_sort(F.transform("_f", lambda v: images[v])).alias("_f")).distinct()
    there = w.select("_w", F.col(right).alias("_r")).join(facts, "_r").select("_w", "_r", F.array_sort("_f").alias("_f")).distinct()
    keys = ["_w", "_r", "_f"]
    wrong = moved.join(there, keys, "left_anti").select("_w").union(there.join(moved, keys, "left_anti").select("_w"))
    constants = there.select("_w", F.explode("_f").alias("c")).groupBy("_w").agg(F.countDistinct("c").alias("_n"))
    images_of = F.array_distinct(F.transform("map", lambda p: p["w"]))
    sources = F.array_distinct(F.transform("map", lambda p: p["v"]))
    fits = (F.size(images_of) == F.size("map")) & (F.size(sources) == F.size("map")) & (F.size("map") == F.coalesce("_n", F.lit(0)))
    out = w.join(constants, "_w", "left").join(wrong.distinct().withColumn("_bad", F.lit(True)), "_w", "left")
    return out.select(*witnesses.columns, (fits & F.col("_bad").isNull()).alias("verified"))


def remainders(records: DataFrame, most: int) -> DataFrame:
    """(rec, dels, deleted, facts, word, named): each record less every set of up to ``most`` of its facts.

    ``deleted`` are the facts that went, in order; constants that no fact is left for go too.
    """
    places = records.select("rec", "facts", F.sequence(F.lit(1), F.size("facts")).alias("all")).where(F.size("facts") > 0)
    less = subsets(places, "all", most).select("rec", "facts", "subset")
    gone = lambda f, i: F.array_contains(F.col("subset"), i + 1)
    left = F.filter("facts", lambda f, i: ~gone(f, i))
    rows = less.select("rec", F.size("subset").alias("dels"), F.array_sort(F.filter("facts", gone)).alias("deleted"), left.alias("facts"))
    return forms(rows)


def compatible(pairs: DataFrame, records: DataFrame, most: int) -> DataFrame:
    """``pairs`` (a, b) with ``floor`` and ``possible``: two bounds that need no search.

    Isomorphic remainders have equally many facts of each arity, so at least ``floor`` facts must go. A constant in more than
    ``most`` facts stays, so the other record must have as many constants as one has of those.
    """
    arity = records.select("rec", F.explode("facts").alias("f")).groupBy("rec", F.size("f").alias("arity")).agg(F.count("*").alias("n"))
    sizes = arity.groupBy("rec").agg(F.sum("n").alias("m"))
    degree = records.select("rec", F.explode("facts").alias("f")).select("rec", F.explode("f").alias("v")).groupBy("rec", "v").agg(F.count("*").alias("d"))
    degree = degree.groupBy("rec").agg(F.count("*").alias("n"), F.count_if(F.col("d") > most).alias("stays"))
    side = lambda df, name: df.select(*[F.col(c).alias(f"{c}_{name}") if c != "rec" else F.col(c).alias(name) for c in df.columns])
    one = pairs.join(side(arity, "a"), "a").withColumnRenamed("arity_a", "arity")
    two = side(arity, "b").withColumnRenamed("arity_b", "arity")
    common = one.join(two, ["b", "arity"]).groupBy("a", "b").agg(F.sum(F.least("n_a", "n_b")).alias("common"))
    out = pairs.join(common, ["a", "b"], "left")
    for name in ("a", "b"):
        out = out.join(side(sizes, name), name, "left").join(side(degree, name), name, "left")
    zero = F.lit(0).cast("long")
    get = lambda c: F.coalesce(c, zero)
    floor = get("m_a") + get("m_b") - 2 * get("common")
    fits = (get("stays_a") <= get("n_b")) & (get("stays_b") <= get("n_a"))
    return out.select("a", "b", floor.alias("floor"), ((floor <= most) & fits).alias("possible"))


def alignments(pairs: DataFrame, records: DataFrame, most: int, per_side: int | None = None) -> DataFrame:
    """(a, b, total, deleted_a, deleted_b, left_a, left_b, map): every two sets of facts, ``most`` of them in all and
    ``per_side`` on each side at most, without which a pair of records is isomorphic.

    ``map`` takes the constants of b that are left (``v``) to those of a (``w``). Pairs that the bounds rule out are not
    searched.
    """
    side = most if per_side is None else min(most, per_side)
    open_pairs = compatible(pairs.select("a", "b").distinct(), records, most).where("possible").select("a", "b")
    both = written(open_pairs)
    asked = both.select(F.col("a").alias("rec")).union(both.select(F.col("b").alias("rec"))).distinct()
    left = written(remainders(records.join(asked, "rec", "left_semi"), side).where("word is not null"))
    x = left.select(F.col("rec").alias("a"), "word", F.col("dels").alias("da"), F.col("deleted").alias("deleted_a"), F.col("facts").alias("left_a"), F.col("named").alias("na"))
    y = left.select(F.col("rec").alias("b"), "word", F.col("dels").alias("db"), F.col("deleted").alias("deleted_b"), F.col("facts").alias("left_b"), F.col("named").alias("nb"))
    found = both.join(x, "a").join(y, ["b", "word"]).where(F.col("da") + F.col("db") <= most)
    pairs_of = F.arrays_zip(F.col("nb").alias("v"), F.col("na").alias("w"))
    return found.select("a", "b", (F.col("da") + F.col("db")).alias("total"), "deleted_a", "deleted_b", "left_a", "left_b", pairs_of.alias("map"))
