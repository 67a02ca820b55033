"""Queries over programs, reach and consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import programs
from ..operators import hypergraph as hg, language, words
from ..sources.collections import EVENT_SQL, event_incidence
from .registry import query

REACH_SQL = (
    "inc2 AS (SELECT DISTINCT hg, e, v FROM inc), primal AS (SELECT DISTINCT a.hg, a.v, b.v AS w FROM inc2 a JOIN inc2 b ON a.hg = b.hg AND a.e = b.e AND a.v <> b.v), "
    "walk(hg, v, w) AS (SELECT DISTINCT hg, v, v FROM inc2 UNION SELECT r.hg, r.v, p.w FROM walk r JOIN primal p ON p.hg = r.hg AND p.v = r.w), comp AS (SELECT hg, v, min(w) AS comp FROM walk GROUP BY hg, v), "
    "f AS (SELECT hg, e, min(comp) AS comp, string_agg(v, ',' ORDER BY v) AS f, count(*) AS a FROM inc2 JOIN comp USING (hg, v) GROUP BY hg, e)"
)


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The connected parts of the users' days as records of their own."""
    inc = event_incidence(spark, sf_dir).select("hg", "e", "v")
    comp = hg.components(inc)
    return inc.join(comp, ["hg", "v"]).select(F.concat_ws(":", F.col("hg").cast("string"), "comp").alias("hg"), "e", "v")


def _programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return programs.encoded(words.decode(words.encode(_components(spark, sf_dir))))


@query(
    f"WITH RECURSIVE {EVENT_SQL}, {REACH_SQL}, d AS (SELECT DISTINCT hg, comp, f, a FROM f), m AS (SELECT hg, comp, count(*) AS m, max(a) AS a FROM d GROUP BY ALL), n AS (SELECT hg, comp, count(*) AS n FROM comp GROUP BY ALL) "
    "SELECT hg || ':' || comp AS hg, CAST(n AS INT) AS n, CAST(m AS INT) AS m, CAST(greatest(2, a) AS INT) AS k FROM m JOIN n USING (hg, comp)"
)
def program_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected records as programs, run again: constants, facts and pointers."""
    found = _programs(spark, sf_dir)
    back = programs.decoded(found).select("hg", F.size("types").alias("n"), F.size("facts").alias("m"))
    return back.join(found.select("hg", "k"), "hg").select("hg", "n", "m", "k")


@query()
def program_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return programs.traced(_programs(spark, sf_dir)).select("hg", "step", "token", "facts")


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    inc = event_incidence(spark, sf_dir)
    facts = inc.groupBy("hg", "e").agg(F.sort_array(F.collect_list("v")).alias("f"))
    records = facts.groupBy("hg").agg(F.sort_array(F.collect_set("f")).alias("facts")).select(F.col("hg").alias("rec"), "facts")
    return records, inc.select(F.col("user_id").alias("grp"), F.col("hg").alias("rec"), "day").distinct()


@query()
def isomorphic_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletions that make a user's day isomorphic to their next one, up to two."""
    records, days = _records(spark, sf_dir)
    after = days.select(F.col("rec").alias("a"), F.lead("rec").over(Window.partitionBy("grp").orderBy("day")).alias("b")).where("b IS NOT NULL")
    return language.reach(language.remainders(records, 2), after, 2)


@query()
def coverage_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user the day that most of their days are one deletion away from."""
    records, days = _records(spark, sf_dir)
    return language.consensus(days.select("grp", "rec"), language.remainders(records, 1), 1)
