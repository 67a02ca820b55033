"""Windowed records over time: tumbling windows, changes between neighbours, and runs of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def windows(events: DataFrame, key: str, ts: str, item: str, width: str) -> DataFrame:
    """(key, start, items, n): the set of items of each key in each tumbling window."""
    win = F.window(ts, width)["start"]
    rows = events.groupBy(F.col(key).alias("key"), win.alias("start")).agg(F.collect_set(item).alias("items"), F.count("*").alias("n"))
    return rows.select("key", "start", F.sort_array("items").alias("items"), "n")


def deltas(found: DataFrame, seconds: int) -> DataFrame:
    """(key, start, gained, lost): changes of the item set from the window just before, where there is one."""
    order = Window.partitionBy("key").orderBy("start")
    before = found.withColumn("last", F.lag("items").over(order)).withColumn("at", F.lag("start").over(order))
    next_to = F.unix_timestamp("start") - F.unix_timestamp("at") == seconds
    rows = before.where(next_to)
    return rows.select("key", "start", F.size(F.array_except("items", "last")).alias("gained"), F.size(F.array_except("last", "items")).alias("lost"))


def runs(found: DataFrame, step: Column, least: int) -> DataFrame:
    """(key, first, last, length): maximal runs of neighbouring windows, by gaps and islands; ``step`` numbers windows."""
    order = Window.partitionBy("key").orderBy("step")
    rows = found.select("key", step.cast("long").alias("step")).distinct()
    rows = rows.withColumn("island", F.col("step") - F.row_number().over(order))
    return rows.groupBy("key", "island").agg(F.min("step").alias("first"), F.max("step").alias("last"), F.count("*").alias("length")).where(
        F.col("length") >= least
    ).drop("island")
