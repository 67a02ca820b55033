"""Cluster measures by squared Euclidean distance, from sums over clusters.

The sum of squared distances from a point x to a cluster of n points with vector sum S and squared norms summing
to T is n |x|^2 - 2 x.S + T, so medoids and silhouettes cost one pass over points and clusters instead of one
over pairs of points. There is one row for each cluster and dimension: clusters are labels, few by nature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _sums(rows: DataFrame) -> DataFrame:
    """(label, n, t, s): size, sum of squared norms and vector sum of each cluster."""
    dims = rows.select("label", F.posexplode("v").alias("k", "x")).groupBy("label", "k").agg(F.sum(F.col("x").cast("double")).alias("s"))
    vector = dims.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "s"))), lambda p: p["s"]).alias("s"))
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(_dot("v", "v")).alias("t"))
    return sizes.join(vector, "label")


def _dot(a: str, b: str):
    parts = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda done, x: done + x)


def mean_costs(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, own, label, n, total, mean): summed and mean squared distance of each point to each cluster."""
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    sums = _sums(rows).select("label", "n", "t", "s")
    points = rows.select("id", F.col("label").alias("own"), "v", _dot("v", "v").alias("q"))
    # One row for each cluster: points x clusters is the size of the result.
    both = points.join(F.broadcast(sums))
    total = F.col("n") * F.col("q") - 2 * _dot("v", "s") + F.col("t")
    return both.select("id", "own", "label", "n", total.alias("total"), (total / F.col("n")).alias("mean"))


def silhouettes(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, own, silhouette): 0 in clusters of one."""
    costs = mean_costs(df, id_col, vector_col, label_col)
    mine = F.col("own") == F.col("label")
    both = costs.groupBy("id", "own").agg(
        F.max(F.when(mine & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"), F.min(F.when(~mine, F.col("mean"))).alias("b")
    )
    value = (F.col("b") - F.col("a")) / F.greatest("a", "b")
    return both.select("id", "own", F.coalesce(F.when(F.greatest("a", "b") > 0, value), F.lit(0.0)).alias("silhouette"))


def davies_bouldin(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(label, worst): the largest (spread + spread) / distance of centroids of each cluster with another."""
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    centres = _sums(rows).select("label", F.transform("s", lambda x: x / F.col("n")).alias("c"))
    away = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda done, x: done + x))
    spread = rows.join(F.broadcast(centres), "label").groupBy("label").agg(F.avg(away(F.col("v").cast("array<double>"), F.col("c"))).alias("w"))
    one = centres.join(spread, "label")
    other = one.select(F.col("label").alias("l2"), F.col("c").alias("c2"), F.col("w").alias("w2"))
    # Pairs of clusters, not of points.
    pairs = one.join(F.broadcast(other), F.col("label") != F.col("l2"))
    return pairs.groupBy("label").agg(F.max((F.col("w") + F.col("w2")) / away(F.col("c"), F.col("c2"))).alias("worst"))
