"""Queries over ladders of edits; their SQL is written out rung by rung."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.ladders import ladder
from ..sources.collections import EVENT_SQL, event_incidence
from .corruptions import _digest
from .registry import query

RUNGS, SEED = 3, 20


def _rung_sql(t: int) -> str:
    at, f = SEED + 10 * t, f"f{t - 1}"
    least = lambda item, seed: f"row_number() OVER (PARTITION BY hg, j ORDER BY {_digest('hg', 'j', item, str(seed))}, {item}) AS r"
    come = f"{_digest('hg', 'j', str(at))} % 2 = 0"
    return (
        f"p{t} AS (SELECT hg, j, greatest(2, len(m)) AS a FROM (SELECT *, {least('e', at + 1)} FROM {f}, tries) WHERE r = 1 AND {come}), "
        f"d{t} AS (SELECT hg, j, list(v ORDER BY v) AS m FROM (SELECT *, {least('v', at + 2)} FROM c, tries) JOIN p{t} USING (hg, j) WHERE r <= a GROUP BY hg, j), "
        f"a{t} AS (SELECT hg, j, m FROM d{t} ANTI JOIN {f} USING (hg, m) ANTI JOIN f0 USING (hg, m) WHERE len(m) > 1), "
        f"g{t} AS (SELECT hg, j, e AS gone FROM (SELECT *, {least('e', at + 3)} FROM {f}, tries WHERE own) WHERE r = 1 AND NOT ({come})), "
        f"t{t} AS (SELECT {f}.hg, j, e, m, own, top, 'del' AS op FROM {f} JOIN g{t} USING (hg) WHERE e <> gone UNION ALL SELECT {f}.hg, j, e, {f}.m, own, top, 'ins' FROM {f} JOIN a{t} USING (hg) "
        f"UNION ALL SELECT hg, j, top, a{t}.m, false, top + 1, 'ins' FROM a{t} JOIN (SELECT hg, max(top) AS top FROM {f} GROUP BY hg) USING (hg)), "
        f"s{t} AS (SELECT hg, j, e, unnest(m) AS v FROM t{t}), n{t} AS (SELECT hg, j, count(DISTINCT v) AS n FROM s{t} GROUP BY hg, j), "
        f"w{t}(hg, j, v) AS (SELECT hg, j, min(v) FROM s{t} GROUP BY hg, j UNION SELECT w.hg, w.j, y.v FROM w{t} w JOIN s{t} x ON x.hg = w.hg AND x.j = w.j AND x.v = w.v JOIN s{t} y ON y.hg = x.hg AND y.j = x.j AND y.e = x.e), "
        f"k{t} AS (SELECT hg, min(j) AS j FROM (SELECT hg, j, count(*) AS n FROM w{t} GROUP BY hg, j) SEMI JOIN (SELECT hg, count(*) AS n FROM c GROUP BY hg) z USING (hg, n) GROUP BY hg), "
        f"f{t} AS (SELECT hg, e, m, own, max(top) OVER (PARTITION BY hg) AS top, op FROM t{t} JOIN k{t} USING (hg, j)), "
    )


LADDER_SQL = (
    f"{EVENT_SQL}, c AS (SELECT DISTINCT hg, v FROM inc), tries AS (SELECT unnest(range(1, 7)) AS j), "
    "f0 AS (SELECT hg, e, list(v ORDER BY v) AS m, true AS own, max(e) OVER (PARTITION BY hg) + 1 AS top, '' AS op FROM inc GROUP BY hg, e), "
    + "".join(_rung_sql(t) for t in range(1, RUNGS + 1))
    + "rungs AS ("
    + " UNION ALL ".join(f"SELECT hg, {t} AS t, e, m, own, op FROM f{t}" for t in range(1, RUNGS + 1))
    + "), old AS (SELECT hg, count(*) AS m FROM f0 GROUP BY hg), delta AS (SELECT hg, t, any_value(old.m) - count(*) FILTER (own) + count(*) FILTER (NOT own) AS delta FROM rungs JOIN old USING (hg) GROUP BY hg, t)"
)


@query(f"WITH RECURSIVE {LADDER_SQL} SELECT hg, CAST(t AS INT) AS t, CAST(e AS INT) AS e, unnest(m) AS v, op, delta FROM rungs JOIN delta USING (hg, t)")
def edit_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rungs from each of the users' days."""
    return ladder(event_incidence(spark, sf_dir), RUNGS, SEED).select("hg", "t", "e", "v", "op", "delta")
