"""Queries that write given tables in other formats and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.state import shared_dir
from ..operators.records import vocabulary
from ..sources import blocks
from ..sources.collections import EVENT_SQL, ORDER_SQL, event_incidence, order_incidence, table
from .registry import query

BLOCK_SQL = (
    f"{EVENT_SQL}, k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS label FROM (SELECT DISTINCT v FROM inc)), r AS (SELECT DISTINCT hg, v, dense_rank() OVER (PARTITION BY hg ORDER BY v) - 1 AS i FROM inc), "
    "l AS (SELECT hg, string_agg(label, ' ' ORDER BY i) AS labels, count(*) AS n FROM r JOIN k USING (v) GROUP BY hg), f AS (SELECT hg, user_id, e, list(i ORDER BY i) AS f FROM inc JOIN r USING (hg, v) GROUP BY ALL), "
    "g AS (SELECT hg, user_id AS class, array_to_string(list(array_to_string(f, ' ') ORDER BY f), ';') AS facts, count(*) AS m FROM f GROUP BY hg, user_id)"
)


def _written(spark: SparkSession, sf_dir: str) -> str:
    inc = event_incidence(spark, sf_dir)
    path = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    known = vocabulary(inc.select(F.lit("v").alias("kind"), F.col("v").alias("name"))).select(F.col("name").alias("v"), F.col("id").alias("label"))
    labelled = inc.join(F.broadcast(known), "v")  # the kinds of event
    blocks.write_blocks(blocks.to_blocks(labelled, "user_id", "label"), path)
    return path


@query(f"WITH {BLOCK_SQL} SELECT class, labels, facts, CAST(n AS INT) AS n, CAST(m AS INT) AS m FROM g JOIN l USING (hg)")
def block_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' days written as block-structured text and read back."""
    back = blocks.read_blocks(spark, _written(spark, sf_dir))
    facts = F.array_join(F.transform("facts", lambda f: F.array_join(f, " ")), ";")
    return back.select("class", F.array_join("labels", " ").alias("labels"), facts.alias("facts"), F.size("labels").alias("n"), F.size("facts").alias("m"))


@query(
    f"WITH {ORDER_SQL}, s AS (SELECT p_partkey AS v, least(p_brand, p_type) || ',' || greatest(p_brand, p_type) AS symbol FROM part) "
    "SELECT symbol, count(DISTINCT s.v) AS parts, count(inc.e) AS incidences, count(DISTINCT inc.e) AS facts FROM s LEFT JOIN inc USING (v) GROUP BY symbol"
)
def labelled_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as facts over parts labelled by brand and type, written as line-aligned files and read back: use of each symbol."""
    part = table(spark, sf_dir, "part")
    labels = part.select(F.col("p_partkey").alias("v"), F.explode(F.array("p_brand", "p_type")).alias("name"))
    folder = f"{shared_dir(spark)}/labelled-{uuid.uuid4().hex}"
    blocks.write_labelled(order_incidence(spark, sf_dir), labels, folder, "orders")
    inc, symbols = blocks.read_labelled(spark, folder, "orders")
    used = symbols.join(inc, "v", "left").groupBy("symbol")
    return used.agg(F.countDistinct("v").alias("parts"), F.count("e").alias("incidences"), F.countDistinct("e").alias("facts"))
