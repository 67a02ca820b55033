"""Token-sequence models: n-gram tables, interpolated Kneser-Ney, divergence and novelty."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def ngrams(tokens: DataFrame, n: int) -> DataFrame:
    """(seq, pos, gram): the runs of ``n`` tokens of each sequence (columns seq, pos, token)."""
    order = Window.partitionBy("seq").orderBy("pos")
    parts = [F.lead("token", k).over(order).alias(f"t{k}") for k in range(n)]
    rows = tokens.select("seq", "pos", *parts).where(F.col(f"t{n - 1}").isNotNull())
    return rows.select("seq", "pos", F.concat_ws(" ", *[f"t{k}" for k in range(n)]).alias("gram"), F.col("t0").alias("first"), F.col(f"t{n - 1}").alias("last"))


def continuations(bigrams: DataFrame) -> DataFrame:
    """(token, left, right): different tokens before and after each token."""
    kinds = bigrams.select("first", "last").distinct()
    left = kinds.groupBy(F.col("last").alias("token")).agg(F.count("*").alias("left"))
    right = kinds.groupBy(F.col("first").alias("token")).agg(F.count("*").alias("right"))
    return left.join(right, "token", "full").select("token", F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("right", F.lit(0)).alias("right"))


def kneser_ney(bigrams: DataFrame, discount: float = 0.75) -> DataFrame:
    """(first, last, times, p): interpolated Kneser-Ney probability of each bigram seen."""
    times = bigrams.groupBy("first", "last").agg(F.count("*").alias("times"))
    after = times.groupBy("first").agg(F.sum("times").alias("total"), F.count("*").alias("kinds"))
    before = times.groupBy("last").agg(F.count("*").alias("left"))
    kinds = F.broadcast(before.agg(F.sum("left").alias("all")))  # one row
    rows = times.join(after, "first").join(before, "last").join(kinds)
    base = F.col("left") / F.col("all")
    p = F.greatest(F.col("times") - discount, F.lit(0.0)) / F.col("total") + discount * F.col("kinds") / F.col("total") * base
    return rows.select("first", "last", "times", p.alias("p"))


def divergence(profile: DataFrame) -> DataFrame:
    """(a, b, jsd): Jensen-Shannon divergence in bits of every two groups' profiles (columns grp, item, n).

    Groups are few (languages, labels); items may be many: they meet by item, and what only one group has
    contributes its whole share.
    """
    totals = profile.groupBy("grp").agg(F.sum("n").alias("t"))
    p = profile.join(F.broadcast(totals), "grp").select("grp", "item", (F.col("n") / F.col("t")).alias("p"))
    one, two = p.select("item", F.col("grp").alias("a"), F.col("p").alias("x")), p.select("item", F.col("grp").alias("b"), F.col("p").alias("y"))
    shared = one.join(two, "item").where("a < b")
    part = lambda u, m: F.col(u) * F.log2(F.col(u) / m)
    mid = (F.col("x") + F.col("y")) / 2
    # Over shared items the two sums; items of one group alone have p log2(p / (p / 2)) = p.
    both = shared.groupBy("a", "b").agg(F.sum(part("x", mid) + part("y", mid)).alias("s"), F.sum("x").alias("px"), F.sum("y").alias("py"))
    names = totals.select(F.col("grp").alias("a")).join(totals.select(F.col("grp").alias("b")), F.col("a") < F.col("b"))
    zero = F.lit(0.0)
    out = names.join(both, ["a", "b"], "left")
    return out.select("a", "b", ((F.coalesce("s", zero) + 1 - F.coalesce("px", zero) + 1 - F.coalesce("py", zero)) / 2).alias("jsd"))


def novelty(sample: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """One row (samples, novel): sample rows, and those whose key the collection doesn't have."""
    seen = known.select(F.col(key).alias("_k")).distinct().withColumn("_seen", F.lit(1))
    rows = sample.join(seen, sample[key] == seen._k, "left")
    return rows.agg(F.count("*").alias("samples"), F.count_if(F.col("_seen").isNull()).alias("novel"))
