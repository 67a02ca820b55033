"""Queries over neighbourhood blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import blocks as bl
from ..sources.collections import table
from .registry import query

SEED = 5
H = lambda text: f"('0x' || substr(md5({text} || '|{SEED}'), 1, 8))::BIGINT"


@query(
    "WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT l_partkey AS a, -l_suppkey AS b FROM lineitem), g AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e), "
    # Free nodes of a round, and with a seed the nodes of the blocks drawn in the round before it.
    "w(round, node, seed) AS (SELECT 0, a, NULL::BIGINT FROM (SELECT DISTINCT a FROM g) UNION ALL "
    "(WITH t AS (SELECT round, node FROM w WHERE seed IS NULL), f AS (SELECT t.round, g.a, g.b FROM t JOIN g ON g.a = t.node JOIN t u ON u.node = g.b), "
    f"k AS (SELECT round, a, b, count(*) OVER (PARTITION BY a) AS n, row_number() OVER (PARTITION BY a ORDER BY {H("a || '|' || b")}, b) AS k FROM f), "
    f"p AS (SELECT round, a, b AS node FROM k WHERE n >= {bl.LEAST - 1} AND k <= {bl.NEIGHBOURS} UNION SELECT round, a, a FROM k WHERE n >= {bl.LEAST - 1}), "
    f"r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY {H('a')}, a) AS place FROM p), won AS (SELECT round, a FROM r GROUP BY round, a HAVING max(place) = 1), "
    "used AS (SELECT p.round, p.node, p.a AS seed FROM p JOIN won ON won.a = p.a) "
    "SELECT round + 1, node, seed FROM used UNION ALL SELECT round + 1, node, NULL FROM t WHERE node NOT IN (SELECT node FROM used) AND EXISTS (SELECT 1 FROM used))) "
    "SELECT seed, node, round::INTEGER AS round FROM w WHERE seed IS NOT NULL"
)
def supply_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint blocks of parts and suppliers (below zero) that lines join."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (-F.col("l_suppkey")).alias("b")).distinct()
    return bl.draw_blocks(edges, SEED)
