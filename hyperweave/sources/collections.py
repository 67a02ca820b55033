"""The given tables as collections of labelled hypergraphs in long form.

A collection is an incidence table: hg (the hypergraph), e (the fact), v (the constant) and pred (the fact's
label). Facts are sets, so incidences are distinct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


#: More days than a record's key has to tell apart: those of 270 years from 1970 on (a prime, so keys spread evenly).
DAYS = 100_003


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hypergraph: an order is a fact, its parts are its constants."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("e"), F.col("l_partkey").alias("v")).distinct()


def customer_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A knowledge base for each customer: orders are facts labelled by priority, parts are constants."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("hg"), F.col("l_orderkey").alias("e"), F.col("l_partkey").alias("v"), F.col("o_orderpriority").alias("pred")
    )


def event_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A knowledge base for each user and day: hours are facts, kinds of event are constants."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") * DAYS + F.datediff(F.to_date("ts"), F.lit("1970-01-01"))).alias("hg"),
        F.col("user_id"),
        F.to_date("ts").alias("day"),
        F.hour("ts").alias("e"),
        F.col("event_type").alias("v"),
    ).distinct()


#: The same collections in SQL, for the oracles.
ORDER_SQL = "inc AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS v FROM lineitem)"
CUSTOMER_SQL = (
    "inc AS (SELECT DISTINCT o_custkey AS hg, l_orderkey AS e, l_partkey AS v, o_orderpriority AS pred "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
)
EVENT_SQL = (
    "inc AS (SELECT DISTINCT user_id * 100003 + (CAST(ts AS DATE) - DATE '1970-01-01') AS hg, user_id, CAST(ts AS DATE) AS day, hour(ts) AS e, "
    "event_type AS v FROM events)"
)
