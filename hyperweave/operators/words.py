"""Fact words: records as token strings, the decoder, and edit operations on words.

A word lists ``T<type>`` for every constant in rank order, then ``F<pred>(r,r,..)`` for every fact, sorted by label
and ranks. The decoder takes tokens in any order: T tokens give the types, F tokens a set of facts; the number of
constants is the larger of the T tokens and the highest rank plus one; empty facts are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .hypergraph import compact


def encode(inc: DataFrame) -> DataFrame:
    """(hg, word): constants ranked by their order, of type 0 unless column ``type`` is there; labels by ``pred``."""
    kind = F.col("type") if "type" in inc.columns else F.lit(0)
    pred = F.col("pred") if "pred" in inc.columns else F.lit(0)
    rows = inc.select("hg", "e", "v", kind.alias("type"), pred.alias("pred"))
    ranked = rows.join(compact(inc), ["hg", "v"])
    facts = ranked.groupBy("hg", "e").agg(F.min("pred").alias("pred"), F.sort_array(F.collect_list("new_v")).alias("r")).select("hg", "pred", "r").distinct()
    text = lambda f: F.concat(F.lit("F"), f["pred"].cast("string"), F.lit("("), F.array_join(f["r"], ","), F.lit(")"))
    tail = facts.groupBy("hg").agg(F.sort_array(F.collect_list(F.struct("pred", "r"))).alias("fs"))
    tail = tail.select("hg", F.array_join(F.transform("fs", text), " ").alias("tail"))
    types = ranked.select("hg", "new_v", "type").distinct()
    head = types.groupBy("hg").agg(F.sort_array(F.collect_list(F.struct("new_v", "type"))).alias("ts"))
    head = head.select("hg", F.array_join(F.transform("ts", lambda t: F.concat(F.lit("T"), t["type"].cast("string"))), " ").alias("head"))
    return head.join(tail, "hg").select("hg", F.concat_ws(" ", "head", "tail").alias("word"))


def decode(words: DataFrame) -> DataFrame:
    """(hg, n, types, facts): types array, facts array<struct<pred, members>>, sorted and distinct."""
    types = F.transform(F.regexp_extract_all("word", F.lit(r"T(\d+)")), lambda t: t.cast("int"))
    tokens = F.regexp_extract_all("word", F.lit(r"(F\d+\([\d,]+\))"))
    members = lambda t: F.array_sort(F.array_distinct(F.transform(F.split(F.regexp_extract(t, r"\((.*)\)", 1), ","), lambda x: x.cast("int"))))
    fact = lambda t: F.struct(F.regexp_extract(t, r"F(\d+)", 1).cast("int").alias("pred"), members(t).alias("members"))
    out = words.select("hg", types.alias("types"), F.array_sort(F.array_distinct(F.transform(tokens, fact))).alias("facts"))
    top = F.coalesce(F.array_max(F.flatten(F.transform("facts", lambda f: f["members"]))), F.lit(-1)) + 1
    n = F.greatest(F.size("types"), top)
    padded = F.concat("types", F.array_repeat(F.lit(0), (n - F.size("types")).cast("int")))
    return out.select("hg", n.alias("n"), padded.alias("types"), "facts")


def string_ball(words: DataFrame, letters: list[str], radius: int, col: str = "word") -> DataFrame:
    """(word, near, dist): all words within ``radius`` edits of each word over an alphabet, with the least edits."""
    out = now = words.select(F.col(col).alias("word")).distinct().select("word", F.col("word").alias("near"), F.lit(0).alias("dist"))
    places = F.sequence(F.lit(0), F.length("near"))
    head, tail = lambda p: F.substring(F.col("near"), F.lit(1), p), lambda p: F.substr(F.col("near"), p + 1)
    within = F.filter(places, lambda p: p < F.length("near"))

    def grown(c: str):
        return F.transform(places, lambda p: F.concat(head(p), F.lit(c), tail(p)))

    def swapped(c: str):
        return F.transform(within, lambda p: F.concat(head(p), F.lit(c), tail(p + 1)))

    shrunk = F.transform(within, lambda p: F.concat(head(p), tail(p + 1)))
    for d in range(1, radius + 1):
        step = F.array_distinct(F.concat(*map(grown, letters), shrunk, *map(swapped, letters)))
        now = now.select("word", F.explode(step).alias("near")).distinct().withColumn("dist", F.lit(d))
        now = now.join(out.select("word", "near"), ["word", "near"], "left_anti")
        out = out.union(now)
    return out
