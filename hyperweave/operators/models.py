"""Profiles of collections and log-probabilities under n-gram models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .hypergraph import arity


def profile(inc: DataFrame) -> DataFrame:
    """(kind, item, n, p): normalised histograms of constants, facts, arities and labels (hg, e, v, pred)."""
    facts = inc.groupBy("hg", "e").agg(F.first("pred").alias("pred"))
    count = lambda df, kind, item: df.groupBy(F.col(item).cast("string").alias("item")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "item", "n")
    parts = [
        count(arity(inc), "arity", "arity"),
        count(facts, "pred", "pred"),
        count(facts.groupBy("hg").agg(F.count("*").alias("m")), "m", "m"),
        count(inc.groupBy("hg").agg(F.countDistinct("v").alias("k")), "n", "k"),
    ]
    rows = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    totals = rows.groupBy("kind").agg(F.sum("n").alias("t"))
    return rows.join(F.broadcast(totals), "kind").select("kind", "item", "n", (F.col("n") / F.col("t")).alias("p"))


def log_probabilities(bigrams: DataFrame, model: DataFrame) -> DataFrame:
    """(seq, logp): the summed logarithms of a sequence's bigram probabilities (model: first, last, p)."""
    rows = bigrams.join(model.select("first", "last", "p"), ["first", "last"])
    return rows.groupBy("seq").agg(F.sum(F.ln("p")).alias("logp"), F.count("*").alias("steps"))
