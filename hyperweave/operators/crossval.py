"""Nearest-neighbour classification of query rows by rows of other folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.state import cut
from .neighbours import nearest


def votes(dist: DataFrame, folds: DataFrame, ks: list[int]) -> DataFrame:
    """(k, i, li, lj, p): for each k the share of each label among a query's k nearest rows of other folds, ties by id.

    ``dist`` has i, j, d, li and lj, ``folds`` id and fold. Where other folds hold fewer rows than k, all of them vote.
    """
    of = lambda c: folds.select(F.col("id").alias(c), F.col("fold").alias(f"f{c}"))
    near = nearest(dist.join(of("i"), "i").join(of("j"), "j").where("fi <> fj"), max(ks))
    each = near.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k")
    n = each.groupBy("k", "i", "li", "lj").agg(F.count("*").alias("n"))
    return n.select("k", "i", "li", "lj", (F.col("n") / F.sum("n").over(Window.partitionBy("k", "i"))).alias("p"))


def scores(shares: DataFrame) -> DataFrame:
    """(k, queries, accuracy, macro_f1, auc): of the label of most votes (ties: the least), macro values over the queries' labels.

    The area under the curve is that of each label's share against all others, ties counted half; labels that all queries
    have, or none has, are left out of its mean.
    """
    shares = cut(shares)
    told = shares.groupBy("k", "i", "li").agg(F.min(F.struct((-F.col("p")).alias("p"), "lj")).alias("b")).select("k", "i", "li", F.col("b.lj").alias("lj"))
    sizes = told.groupBy("k").agg(F.count("*").alias("all"))
    own = told.groupBy("k", F.col("li").alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("li") == F.col("lj")).alias("tp"))
    own = cut(own.join(told.groupBy("k", F.col("lj").alias("label")).agg(F.count("*").alias("told")), ["k", "label"], "left").join(sizes, "k"))
    # Queries by their share of a label; those without a vote for it have share 0.
    right = F.count_if(F.col("li") == F.col("lj"))
    some = shares.groupBy("k", F.col("lj").alias("label"), "p").agg(right.alias("pos"), (F.count("*") - right).alias("neg"))
    seen = some.groupBy("k", "label").agg(F.sum("pos").alias("sp"), F.sum("neg").alias("sn"))
    rest = own.join(seen, ["k", "label"], "left").select(
        "k", "label", F.lit(0.0).alias("p"), (F.col("n") - F.coalesce("sp", F.lit(0))).alias("pos"), (F.col("all") - F.col("n") - F.coalesce("sn", F.lit(0))).alias("neg")
    )
    below = Window.partitionBy("k", "label").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # k + 1 shares at most
    steps = some.unionByName(rest).withColumn("below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    area = steps.groupBy("k", "label").agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("wins"))
    pairs = F.col("n") * (F.col("all") - F.col("n"))
    each = own.join(area, ["k", "label"]).withColumn("auc", F.try_divide("wins", pairs)).withColumn("f1", 2 * F.col("tp") / (F.coalesce("told", F.lit(0)) + F.col("n")))
    return each.groupBy("k").agg(F.sum("n").alias("queries"), (F.sum("tp") / F.sum("n")).alias("accuracy"), F.avg("f1").alias("macro_f1"), F.avg("auc").alias("auc"))
