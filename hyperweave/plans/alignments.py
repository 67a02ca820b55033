"""Queries over certificates and alignments of the users' days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import alignments as al
from ..sources.collections import EVENT_SQL
from .language import _records
from .registry import query

#: Facts of each record in order; a key of what is isomorphic: the least of the facts under all orders of the constants.
FACTS_SQL = (
    f"{EVENT_SQL}, f AS (SELECT DISTINCT hg, f FROM (SELECT hg, e, list(v ORDER BY v) AS f FROM inc GROUP BY hg, e)), "
    "rec AS MATERIALIZED (SELECT hg, list(f ORDER BY f) AS facts FROM f GROUP BY hg), "
    "o(n, p) AS (SELECT n, []::INT[] FROM range(0, 6) g(n) UNION ALL SELECT n, list_append(p, k::INT) FROM o, range(1, 6) g(k) WHERE k <= n AND NOT list_contains(p, k)), "
    "perms AS MATERIALIZED (SELECT n, p FROM o WHERE len(p) = n)"
)
DAYS_SQL = "days AS (SELECT hg AS a, lead(hg) OVER (PARTITION BY user_id ORDER BY day) AS b FROM (SELECT DISTINCT hg, user_id, day FROM inc))"


def key_sql(source: str) -> str:
    """A select of all columns of ``source`` (with facts) and ``key``, equal for isomorphic facts."""
    image = "list_sort(list_transform(facts, lambda f: list_sort(list_transform(f, lambda v: p[list_position(c, v)]))))"
    return (
        f"SELECT any_value(COLUMNS(* EXCLUDE (n, p, c, k, id))), min(k) AS key FROM (SELECT *, n || ':' || ({image})::VARCHAR AS k FROM "
        f"(SELECT *, row_number() OVER () AS id, list_sort(list_distinct(flatten(facts))) AS c FROM {source}) x JOIN perms ON n = len(c)) GROUP BY id"
    )


@query(
    f"WITH RECURSIVE {FACTS_SQL}, k AS ({key_sql('rec')}) "
    "SELECT hg, min(hg) OVER (PARTITION BY key) AS first_hg, len(facts) AS facts, len(list_distinct(flatten(facts))) AS constants, true AS verified FROM k"
)
def bijection_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's map to the first record isomorphic to it, verified fact by fact in both directions."""
    records, _ = _records(spark, sf_dir)
    named = al.forms(records)
    found = al.verified(al.certificates(named), records)
    sizes = records.select("rec", F.size("facts").cast("long").alias("facts"))
    return found.join(sizes, "rec").select(F.col("rec").alias("hg"), F.col("first").alias("first_hg"), "facts", F.size("map").cast("long").alias("constants"), "verified")


def _next_days(days: DataFrame) -> DataFrame:
    after = F.lead("rec").over(Window.partitionBy("grp").orderBy("day"))
    return days.select(F.col("rec").alias("a"), after.alias("b")).where("b IS NOT NULL")


@query(
    f"WITH {EVENT_SQL}, {DAYS_SQL}, f AS (SELECT DISTINCT hg, f FROM (SELECT hg, e, list(v ORDER BY v) AS f FROM inc GROUP BY hg, e)), "
    "ar AS (SELECT hg, len(f) AS arity, count(*) AS n FROM f GROUP BY ALL), m AS (SELECT hg, sum(n) AS m FROM ar GROUP BY hg), "
    "d AS (SELECT hg, v, count(*) AS d FROM (SELECT hg, unnest(f) AS v FROM f) GROUP BY ALL), s AS (SELECT hg, count(*) AS n, count(*) FILTER (d > 2) AS stays FROM d GROUP BY hg), "
    "p AS (SELECT a, b FROM days WHERE b IS NOT NULL), c AS (SELECT a, b, sum(least(x.n, y.n)) AS common FROM p JOIN ar x ON x.hg = a JOIN ar y ON y.hg = b AND y.arity = x.arity GROUP BY a, b), "
    "z AS (SELECT a, b, (ma.m + mb.m - 2 * coalesce(common, 0))::BIGINT AS floor, sa.stays <= sb.n AND sb.stays <= sa.n AS fits FROM p LEFT JOIN c USING (a, b) JOIN m ma ON ma.hg = a JOIN m mb ON mb.hg = b JOIN s sa ON sa.hg = a JOIN s sb ON sb.hg = b) "
    "SELECT a, b, floor, floor <= 2 AND fits AS possible FROM z"
)
def reach_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds on how many facts must go for a user's day to be like their next one, without a search."""
    records, days = _records(spark, sf_dir)
    return al.compatible(_next_days(days), records, 2)


CUT_SQL = (
    "marks AS (SELECT hg, facts, i, j FROM rec, LATERAL (SELECT unnest(range(0, len(facts) + 1)) AS i) x, LATERAL (SELECT unnest(range(0, len(facts) + 1)) AS j) y WHERE i < j OR (i = 0 AND j = 0)), "
    "less AS MATERIALIZED (SELECT hg, list_filter(facts, lambda f, k: k <> i AND k <> j) AS facts, list_filter(facts, lambda f, k: k = i OR k = j) AS deleted FROM marks)"
)


@query(
    f"WITH RECURSIVE {FACTS_SQL}, {DAYS_SQL}, {CUT_SQL}, k AS MATERIALIZED ({key_sql('less')}) "
    "SELECT a, b, CAST(len(x.deleted) + len(y.deleted) AS INT) AS total, array_to_string(list_transform(x.deleted, lambda f: array_to_string(f, '+')), ';') AS deleted_a, "
    "array_to_string(list_transform(y.deleted, lambda f: array_to_string(f, '+')), ';') AS deleted_b, CAST(len(list_distinct(flatten(x.facts))) AS INT) AS mapped, true AS verified "
    "FROM days JOIN k x ON x.hg = a JOIN k y ON y.hg = b AND y.key = x.key WHERE len(x.deleted) + len(y.deleted) <= 2"
)
def record_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way to make a user's day isomorphic to their next one by up to two deletions, with a map that is applied and compared."""
    records, days = _records(spark, sf_dir)
    found = al.alignments(_next_days(days), records, 2)
    applied = al.carried("left_b", "map") == F.array_sort(F.transform("left_a", lambda m: F.array_sort(m)))
    text = lambda c: F.array_join(F.transform(c, lambda f: F.array_join(f, "+")), ";").alias(c)
    return found.select("a", "b", "total", text("deleted_a"), text("deleted_b"), F.size("map").alias("mapped"), applied.alias("verified"))
