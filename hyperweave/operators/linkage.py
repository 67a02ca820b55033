"""Average linkage on tables of distances: merges, cuts, cophenetic distances.

Distances are rows (grp, i, j, d), one for each pair i < j of a group; all groups are linked at once. In a round every
cluster finds its nearest one, and each two that are each other's nearest are merged: with averages, a merge never
brings a third cluster nearer than the two were to each other, so these are the merges that one after the other would
make. The sums of distances between clusters are added up anew under the new names, which is all that averages need. A
cluster is named by its least member.

Ties go to the lesser names. Equal distances may so give another tree than merging one pair at a time, of the same heights
where only pairs apart from each other tie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.state import written


def average_linkage(dist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merges, cophenetic): merges (grp, a, b, height, size) with a < b, and (grp, i, j, d, height) of every pair."""
    pairs = written(dist.where("i < j").select("grp", "i", "j", F.col("d").cast("double").alias("d"), F.col("i").alias("a"), F.col("j").alias("b")))
    ends = pairs.select("grp", F.col("i").alias("c")).union(pairs.select("grp", F.col("j").alias("c"))).distinct()
    sizes = written(ends.withColumn("n", F.lit(1).cast("long")))
    merged, joined = [], []
    while not pairs.isEmpty():
        sums = written(pairs.groupBy("grp", "a", "b").agg(F.sum("d").alias("s")))
        n = lambda name, size: sizes.select("grp", F.col("c").alias(name), F.col("n").alias(size))
        apart = sums.join(n("a", "na"), ["grp", "a"]).join(n("b", "nb"), ["grp", "b"])
        apart = apart.select("grp", "a", "b", (F.col("s") / (F.col("na") * F.col("nb"))).alias("h"), (F.col("na") + F.col("nb")).alias("size"))
        both = apart.select("grp", F.col("a").alias("c"), F.struct("h", "a", "b", "size").alias("x")).union(apart.select("grp", "b", F.struct("h", "a", "b", "size")))
        nearest = both.groupBy("grp", "c").agg(F.min("x").alias("x"))
        # A pair that is nearest to both of its clusters is there twice.
        new = nearest.groupBy("grp", F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("x.h").alias("height"), F.col("x.size").alias("size")).agg(F.count("*").alias("k"))
        new = written(new.where("k = 2").drop("k"))
        merged.append(new)
        names = new.select("grp", F.col("b").alias("old"), F.col("a").alias("new"), "height")
        for c in ("a", "b"):
            to = names.select("grp", F.col("old").alias(c), F.col("new").alias(f"_{c}"), F.col("height").alias(f"_h{c}"))
            pairs = pairs.join(to, ["grp", c], "left")
        a, b = F.coalesce("_a", "a"), F.coalesce("_b", "b")
        pairs = written(pairs.select("grp", "i", "j", "d", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.coalesce("_hb", "_ha").alias("height")))
        # The two names of a pair become one in the round that merges them; the greater one was changed then.
        joined.append(pairs.where("a = b").select("grp", "i", "j", "d", "height"))
        pairs = pairs.where("a < b").drop("height")
        kept = sizes.join(new.select("grp", F.col("b").alias("c")), ["grp", "c"], "left_anti")
        grown = new.select("grp", F.col("a").alias("c"), F.col("size").alias("_n"))
        sizes = written(kept.join(grown, ["grp", "c"], "left").select("grp", "c", F.coalesce("_n", "n").alias("n")))
    empty = dist.select("grp", "i", "j", F.col("d").cast("double").alias("d"), F.lit(0.0).alias("height")).where("false")
    none = dist.select("grp", F.col("i").alias("a"), F.col("j").alias("b"), F.lit(0.0).alias("height"), F.lit(0).cast("long").alias("size")).where("false")
    for more in merged:
        none = none.union(more)
    for more in joined:
        empty = empty.union(more)
    return none, empty


def cut(merges: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(grp, item, cluster): the ``k`` clusters (all items, if fewer) that a group's last merges leave apart, by their least member.

    A merged cluster points to the one that took it; pointers are followed by doubling.
    """
    size = items.groupBy("grp").agg(F.count("*").alias("_n"))
    rank = F.row_number().over(Window.partitionBy("grp").orderBy("height", "a", "b"))  # one row for each item of a group
    kept = merges.withColumn("_r", rank).join(size, "grp").where(F.col("_r") <= F.col("_n") - k)
    to = kept.select("grp", F.col("b").alias("item"), F.col("a").alias("_to"))
    state = written(items.select("grp", "item").join(to, ["grp", "item"], "left").select("grp", "item", F.coalesce("_to", "item").alias("cluster")))
    while True:
        next_ = state.select("grp", F.col("item").alias("cluster"), F.col("cluster").alias("_next"))
        further = written(state.join(next_, ["grp", "cluster"]).select("grp", "item", "cluster", "_next"))
        state = further.select("grp", "item", F.col("_next").alias("cluster"))
        if further.where("_next <> cluster").isEmpty():
            return state


def cophenetic_correlation(cophenetic: DataFrame) -> DataFrame:
    """(grp, pairs, correlation): of the distances with the heights at which their pairs are joined."""
    return cophenetic.groupBy("grp").agg(F.count("*").alias("pairs"), F.corr("d", "height").alias("correlation"))
