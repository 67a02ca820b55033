"""Queries over intervals and paired comparisons of the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import intervals as iv
from ..sources.collections import table
from .registry import query


def _horner(x: str, terms: tuple) -> str:
    out = repr(terms[0])
    for c in terms[1:]:
        out = f"({out} * {x} + {c!r})"
    return out.replace("e-", "E-")


def cdf_sql(x: str) -> str:
    t = f"(1 / (1 + {iv.CDF_SCALE}::DOUBLE * abs({x}) / sqrt(2.0::DOUBLE)))"
    tail = f"({_horner(t, iv.CDF[::-1])} * {t} * exp(-({x}) * ({x}) / 2) / 2)"
    return f"(CASE WHEN {x} < 0 THEN {tail} ELSE 1 - {tail} END)"


def quantile_sql(p: str) -> str:
    far = lambda s: f"({_horner(f'sqrt(-2 * ln({s}))', iv.TAIL_TOP)} / {_horner(f'sqrt(-2 * ln({s}))', iv.TAIL_BOTTOM)})"
    q = f"({p} - 0.5::DOUBLE)"
    return (
        f"(CASE WHEN {p} < {iv.TAIL} THEN {far(p)} WHEN {p} > 1 - {iv.TAIL}::DOUBLE THEN -{far(f'(1 - {p})')} "
        f"ELSE {_horner(f'({q} * {q})', iv.CENTRE_TOP)} * {q} / {_horner(f'({q} * {q})', iv.CENTRE_BOTTOM)} END)"
    )


DRAWS, SEED = 200, 7


def bca_sql(unit: str) -> str:
    weight = " + ".join(f"(u >= {c}::DOUBLE)::INT" for c in iv.POISSON)
    at = lambda share: f"ms[floor({share} * (len(ms) - 1))::INT + 1] + ({share} * (len(ms) - 1) - floor({share} * (len(ms) - 1))) * (ms[least(floor({share} * (len(ms) - 1))::INT + 2, len(ms))] - ms[floor({share} * (len(ms) - 1))::INT + 1])"
    return (
        f"WITH r AS MATERIALIZED (SELECT event_type, {unit} AS unit, sum(value) AS s, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL), "
        'tot AS (SELECT event_type, sum(s) AS "all", sum(n) AS cnt, count(*) AS units FROM r GROUP BY event_type), '
        f"d AS (SELECT event_type, s, n, draw, ('0x' || substr(md5(unit || '|' || draw || '|{SEED}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM r, range(1, {DRAWS + 1}) g(draw)), "
        f"m AS (SELECT event_type, draw, sum(w * s) / sum(w * n) AS m, sum(w) AS drawn FROM (SELECT *, {weight} AS w FROM d) GROUP BY ALL), "
        "l AS (SELECT event_type, list(m ORDER BY m) AS ms FROM m WHERE drawn > 0 GROUP BY event_type), "
        'j AS (SELECT r.event_type, ("all" - s) / (cnt - n) AS j FROM r JOIN tot USING (event_type) WHERE cnt > n), c AS (SELECT event_type, avg(j) AS c FROM j GROUP BY event_type), '
        "k AS (SELECT event_type, sum((c - j) * (c - j) * (c - j)) AS cubes, sum((c - j) * (c - j)) AS squares FROM j JOIN c USING (event_type) GROUP BY event_type), "
        'x AS (SELECT event_type, units, "all" / cnt AS mean, ms, len(list_filter(ms, lambda y: y < "all" / cnt))::DOUBLE / len(ms) AS below, CASE WHEN squares > 0 THEN cubes / (6 * pow(squares, 1.5::DOUBLE)) END AS a FROM tot JOIN l USING (event_type) LEFT JOIN k USING (event_type)), '
        "y AS (SELECT *, CASE WHEN list_max(ms) = list_min(ms) THEN 'constant' WHEN below > 0 AND below < 1 AND a IS NOT NULL THEN 'bca' ELSE 'percentile' END AS method FROM x), "
        f"z AS (SELECT *, CASE WHEN method = 'bca' THEN {quantile_sql('below')} END AS z0 FROM y), "
        f"q AS (SELECT *, z0 + (z0 - {iv.Z}::DOUBLE) / (1 - a * (z0 - {iv.Z}::DOUBLE)) AS zl, z0 + (z0 + {iv.Z}::DOUBLE) / (1 - a * (z0 + {iv.Z}::DOUBLE)) AS zh FROM z), "
        f"p AS (SELECT *, CASE WHEN method = 'bca' THEN {cdf_sql('zl')} ELSE 0.025::DOUBLE END AS pl, CASE WHEN method = 'bca' THEN {cdf_sql('zh')} ELSE 0.975::DOUBLE END AS ph FROM q) "
        f"SELECT event_type, units, round(mean, 6) AS mean, round(CASE WHEN method = 'constant' THEN mean ELSE {at('pl')} END, 6) AS low, round(CASE WHEN method = 'constant' THEN mean ELSE {at('ph')} END, 6) AS high, method FROM p"
    )


def _bca(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    found = iv.bca_interval(table(spark, sf_dir, "events").select("event_type", "value", F.col(unit).alias("unit")), "event_type", "value", "unit", DRAWS, SEED)
    return found.select("event_type", "units", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")], "method")


@query(bca_sql("event_id"))
def bca_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bias-corrected and accelerated interval of the mean value of each kind of event."""
    return _bca(spark, sf_dir, "event_id")


@query(bca_sql("user_id"))
def clustered_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with all events of a user drawn together."""
    return _bca(spark, sf_dir, "user_id")


@query(
    "WITH RECURSIVE u AS (SELECT user_id, event_type, round(avg(value), 9) AS v FROM events GROUP BY ALL), base AS (SELECT min(event_type) AS b FROM events), "
    "g AS (SELECT CASE WHEN x.event_type < 'm' THEN 'first' ELSE 'second' END AS family, x.event_type AS name, round(x.v - y.v, 9) AS gap FROM u x JOIN base ON x.event_type <> b JOIN u y ON y.event_type = b AND y.user_id = x.user_id), "
    "e AS (SELECT family, name, count(*) FILTER (gap = 0) AS ties FROM g GROUP BY ALL), "
    "r AS MATERIALIZED (SELECT family, name, gap, (2 * rank() OVER w + count(*) OVER (PARTITION BY family, name, abs(gap)) - 1)::BIGINT AS r, row_number() OVER (PARTITION BY family, name ORDER BY abs(gap), gap) AS k FROM g WHERE gap <> 0 WINDOW w AS (PARTITION BY family, name ORDER BY abs(gap))), "
    "c AS (SELECT family, name, sum(k * k * k - k) AS tied FROM (SELECT family, name, count(*) AS k FROM r GROUP BY family, name, abs(gap)) GROUP BY ALL), "
    "s AS (SELECT family, name, count(*) AS n, coalesce(sum(r) FILTER (gap > 0), 0)::BIGINT AS up2, coalesce(sum(r) FILTER (gap < 0), 0)::BIGINT AS down2 FROM r GROUP BY ALL), "
    f"d(family, name, k, s, p) AS (SELECT family, name, 0::BIGINT, 0::BIGINT, 1.0::DOUBLE FROM s WHERE n <= {iv.EXACT_PAIRS} UNION ALL "
    "SELECT d.family, d.name, d.k + 1, d.s + r.r * t, sum(p / 2) FROM d JOIN r ON r.family = d.family AND r.name = d.name AND r.k = d.k + 1, range(2) h(t) GROUP BY d.family, d.name, d.k, d.s + r.r * t), "
    "w AS (SELECT d.family, d.name, sum(p) FILTER (d.s >= up2) AS hi, sum(p) FILTER (d.s <= up2) AS lo FROM d JOIN s ON s.family = d.family AND s.name = d.name AND s.n = d.k GROUP BY ALL), "
    "f AS (SELECT s.*, e.ties, hi, lo, abs(up2 / 2.0::DOUBLE - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - tied / 48.0::DOUBLE) AS z FROM s JOIN e USING (family, name) JOIN c USING (family, name) LEFT JOIN w USING (family, name)), "
    f"p AS (SELECT *, n <= {iv.EXACT_PAIRS} AS exact, CASE WHEN n <= {iv.EXACT_PAIRS} THEN least(1.0::DOUBLE, 2 * least(hi, lo)) ELSE 2 * {cdf_sql('(-z)')} END AS p FROM f), "
    "h AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, name) AS k, count(*) OVER (PARTITION BY family) AS m FROM p) "
    "SELECT family, name, n, ties, up2 / 2.0::DOUBLE AS plus, down2 / 2.0::DOUBLE AS minus, round((up2 - down2)::DOUBLE / (up2 + down2), 6) AS biserial, exact, round(p, 7) AS p, "
    "round(max(least(1.0::DOUBLE, (m - k + 1) * p)) OVER (PARTITION BY family ORDER BY p, name ROWS UNBOUNDED PRECEDING), 7) AS adjusted FROM h"
)
def paired_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of event against the first one by users' mean values: signed ranks, chances, corrected within families."""
    events = table(spark, sf_dir, "events")
    means = events.groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 9).alias("v"))
    base = F.broadcast(events.agg(F.min("event_type").alias("b")))  # one row
    marked = means.join(base)
    other = marked.where("event_type <> b").select("user_id", F.col("event_type").alias("name"), "v")
    first = marked.where("event_type = b").select("user_id", F.col("v").alias("w"))
    gaps = other.join(first, "user_id").select(F.when(F.col("name") < "m", "first").otherwise("second").alias("family"), "name", F.round(F.col("v") - F.col("w"), 9).alias("gap"))
    found = iv.paired_family(gaps)
    return found.select("family", "name", "n", "ties", "plus", "minus", F.round("biserial", 6).alias("biserial"), "exact", F.round("p", 7).alias("p"), F.round("adjusted", 7).alias("adjusted"))
