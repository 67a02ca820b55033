"""Queries over corruptions with budgets. Twins and exchanged arguments are verified by canonical words, which SQL lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import corruptions as co
from ..sources.collections import EVENT_SQL, event_incidence
from .registry import query


def _digest(*parts: str) -> str:
    return f"('0x' || substr(md5({' || chr(124) || '.join(parts)}), 1, 8))::BIGINT"


@query(
    f"WITH {EVENT_SQL}, f AS (SELECT hg, e, list(v ORDER BY v) AS m FROM inc GROUP BY hg, e), c AS (SELECT DISTINCT hg, v FROM inc), s AS (SELECT hg, count(*) AS n FROM c GROUP BY hg HAVING count(*) > 1), t AS (SELECT unnest(range(1, 21)) AS j), "
    f"p AS (SELECT hg, j, greatest(2, len(m)) AS a FROM (SELECT *, row_number() OVER (PARTITION BY hg, j ORDER BY {_digest('hg', 'j', 'e', '5')}, e) AS r FROM f, t) WHERE r = 1), "
    f"d AS (SELECT hg, j, list(v ORDER BY v) AS m FROM (SELECT *, row_number() OVER (PARTITION BY hg, j ORDER BY {_digest('hg', 'j', 'v', '6')}, v) AS r FROM c, t) JOIN p USING (hg, j) JOIN s USING (hg) WHERE r <= a GROUP BY hg, j), "
    "k AS (SELECT hg, m, row_number() OVER (PARTITION BY hg ORDER BY min(j)) AS k FROM d ANTI JOIN f USING (hg, m) GROUP BY hg, m), done AS (SELECT hg FROM k WHERE k = 2), last AS (SELECT hg, max(e) AS last FROM f GROUP BY hg), "
    "every AS (SELECT hg, e, m FROM f UNION ALL SELECT hg, last + k, m FROM k JOIN last USING (hg) WHERE k <= 2) SELECT hg, CAST(e AS INT) AS e, unnest(m) AS v FROM every SEMI JOIN done USING (hg)"
)
def corrupt_spurious_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' days with two facts that they don't hold; days without room for two are left out."""
    return co.spurious_facts(event_incidence(spark, sf_dir), 2, 5).select("hg", "e", "v")


@query(
    f"WITH {EVENT_SQL}, r AS (SELECT hg, e, row_number() OVER (PARTITION BY hg ORDER BY {_digest('hg', 'e', '7')}, e) AS r FROM (SELECT DISTINCT hg, e FROM inc)) "
    "SELECT hg, CAST(e AS INT) AS e, v FROM inc JOIN r USING (hg, e) WHERE r > 2"
)
def corrupt_missing_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' days without two of their facts; days of two or fewer are left out."""
    return co.missing_facts(event_incidence(spark, sf_dir), 2, 7).select("hg", "e", "v")


@query()
def corrupt_wrong_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' days with two exchanged arguments, those that are no longer isomorphic to the day."""
    return co.wrong_arguments(event_incidence(spark, sf_dir), 2, 8).select("hg", "e", "v")


@query()
def isomorphic_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' days after swaps that keep degrees and arities, until they are not isomorphic to the day."""
    return co.iso_twins(event_incidence(spark, sf_dir), 9).select("hg", "e", "v", "swaps")
