"""Queries over spectra of dissimilarities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import dissimilarity as ds
from .linkage import ITEM_SQL, _items
from .registry import query
from .scaling import axes_sql

#: Permutations that chance is judged by.
DRAWS = 19

#: Squared distances of a region's items as dissimilarities, which no Euclidean space holds, and their centred matrices.
MATRIX_SQL = (
    "s AS (SELECT grp, i, j, d * d * d * d AS s FROM d UNION ALL SELECT grp, j, i, d * d * d * d FROM d UNION ALL SELECT grp, item, item, 0 FROM x), "
    "m AS (SELECT grp, i, avg(s) AS m FROM s GROUP BY grp, i), w AS (SELECT grp, avg(s) AS w FROM s GROUP BY grp), "
    "g1 AS MATERIALIZED (SELECT s.grp, s.i, s.j, -0.5 * (s - a.m - b.m + w) AS g FROM s JOIN m a ON a.grp = s.grp AND a.i = s.i JOIN m b ON b.grp = s.grp AND b.i = s.j JOIN w ON w.grp = s.grp)"
)


def _squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir)[1].select("grp", "i", "j", (F.col("d") * F.col("d")).alias("d"))


@query(
    f"WITH RECURSIVE {ITEM_SQL}, {MATRIX_SQL}, {axes_sql(4)}, whole AS (SELECT grp, sum(CASE WHEN i = j THEN g END) AS one, sum(g * g) AS two FROM g1 GROUP BY grp) "
    "SELECT grp AS region, dim AS place, round(value / one, 6) AS share, round(value * value / two, 6) AS square_share FROM (SELECT DISTINCT grp, dim, value FROM axis) JOIN whole USING (grp)"
)
def dissimilarity_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four eigenvalues furthest from zero of each region's squared distances between market segments, as shares of all of them."""
    values = ds.spectra(_squares(spark, sf_dir))
    # A region has 25 items, so 24 values at most.
    each = values.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct(F.abs("value").alias("size"), "value")), asc=False).alias("x"), F.sum("value").alias("one"), F.sum(F.col("value") ** 2).alias("two"))
    rows = each.select("grp", "one", "two", F.posexplode(F.slice("x", 1, 4)).alias("at", "p"))
    value = F.col("p.value")
    return rows.select(
        F.col("grp").cast("int").alias("region"), (F.col("at") + 1).alias("place"), F.round(value / F.col("one"), 6).alias("share"), F.round(value * value / F.col("two"), 6).alias("square_share")
    )


@query()
def dimensions_beyond_chance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions of each region's market segments that permuted distances don't show, and how far from Euclidean their squares are."""
    found = ds.dimensions(_squares(spark, sf_dir), DRAWS)
    return found.select(F.col("grp").cast("int").alias("region"), "found", "dimensions", F.round("negative", 6).alias("negative"), "whole")
