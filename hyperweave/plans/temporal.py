"""Queries over time: windows of events, changes and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import temporal as tm
from ..sources.collections import table
from ..streaming.windows import run_stream
from .registry import query

DAY_SQL = (
    "w AS (SELECT user_id AS key, date_trunc('day', ts)::TIMESTAMP AS start, list_sort(list(DISTINCT event_type)) AS items, count(*) AS n FROM events GROUP BY ALL)"
)
DELTA_SQL = (
    f"{DAY_SQL}, p AS (SELECT key, start, items, lag(items) OVER o AS last, lag(start) OVER o AS prior FROM w WINDOW o AS (PARTITION BY key ORDER BY start)), "
    "d AS (SELECT key, start, len(list_filter(items, lambda x: NOT list_contains(last, x)))::INT AS gained, len(list_filter(last, lambda x: NOT list_contains(items, x)))::INT AS lost FROM p WHERE start - prior = INTERVAL 1 DAY)"
)
RUN_SQL = (
    f"{DAY_SQL}, s AS (SELECT key, epoch(start)::BIGINT // 86400 AS step FROM w), i AS (SELECT key, step, step - row_number() OVER (PARTITION BY key ORDER BY step) AS island FROM s), "
    "r AS (SELECT key, min(step) AS first, max(step) AS last, count(*) AS length FROM i GROUP BY key, island HAVING count(*) >= 2)"
)


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.windows(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "1 day")


def _step():
    return F.floor(F.unix_timestamp("start") / 86400)


@query(f"WITH {DAY_SQL} SELECT key, start, array_to_string(items, ',') AS items, n FROM w")
def windowed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir).select("key", "start", F.array_join("items", ",").alias("items"), "n")


@query(f"WITH {DELTA_SQL} SELECT key, start, gained, lost FROM d")
def window_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.deltas(_days(spark, sf_dir), 86400)


@query(f"WITH {DELTA_SQL} SELECT gained + lost AS change, count(*) AS windows FROM d GROUP BY ALL")
def delta_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_delta(spark, sf_dir).groupBy((F.col("gained") + F.col("lost")).alias("change")).agg(F.count("*").alias("windows"))


@query(f"WITH {RUN_SQL} SELECT key, first, last, length FROM r")
def window_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.runs(_days(spark, sf_dir), _step(), 2)


@query(f"WITH {DAY_SQL} SELECT key, count(*) AS versions, min(start) AS first, max(start) AS last FROM w GROUP BY key HAVING count(*) >= 3")
def lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with three or more daily versions."""
    found = _days(spark, sf_dir).groupBy("key").agg(F.count("*").alias("versions"), F.min("start").alias("first"), F.max("start").alias("last"))
    return found.where("versions >= 3")


@query("SELECT event_type AS type, date_trunc('month', ts)::TIMESTAMP AS month, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def monthly_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("month", F.date_trunc("month", "ts"))
    return events.groupBy(F.col("event_type").alias("type"), "month").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.countDistinct("user_id").alias("users")
    )


@query("SELECT year(o_orderdate)::INT AS year, quarter(o_orderdate)::INT AS quarter, o_orderpriority AS pred, count(*) AS facts FROM orders GROUP BY ALL")
def quarter_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"), F.col("o_orderpriority").alias("pred")).agg(
        F.count("*").alias("facts")
    )


@query("SELECT user_id AS key, date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of each user by a stream over the events, equal to the batch."""
    return run_stream(spark, f"{sf_dir}/events.parquet", "user_id", "ts", "1 day")
