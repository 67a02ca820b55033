"""Block designs and regular families as tables of edges (e, members), by arithmetic over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _members(df: DataFrame) -> DataFrame:
    """(e, members): blocks numbered in the order of their sorted members."""
    rows = df.select(F.array_sort(F.array_distinct("members")).alias("members")).distinct()
    return rows.select("members").orderBy("members").coalesce(1).select(F.monotonically_increasing_id().alias("e"), "members")


def cyclic(spark: SparkSession, order: int, base: list[int]) -> DataFrame:
    """The blocks base + i modulo ``order``."""
    shift = F.transform(F.array(*map(F.lit, base)), lambda b: F.pmod(b + F.col("id"), F.lit(order)))
    return _members(spark.range(order).select(shift.cast("array<int>").alias("members")))


def fano_plane(spark: SparkSession) -> DataFrame:
    """Seven points and seven lines, by a difference set modulo 7."""
    return cyclic(spark, 7, [0, 1, 3])


def affine_plane(spark: SparkSession, p: int) -> DataFrame:
    """The lines of the affine plane over a prime field; p = 3 is the Steiner triple system on nine points."""
    line = spark.range(p).withColumnRenamed("id", "a").join(spark.range(p).withColumnRenamed("id", "b"))
    places = F.sequence(F.lit(0), F.lit(p - 1))
    sloped = line.select(F.transform(places, lambda x: x * p + F.pmod(F.col("a") * x + F.col("b"), F.lit(p))).cast("array<int>").alias("members"))
    upright = spark.range(p).select(F.transform(places, lambda y: F.col("id") * p + y).cast("array<int>").alias("members"))
    return _members(sloped.union(upright))


def generalised_quadrangle(spark: SparkSession) -> DataFrame:
    """GQ(2,2): points are the pairs of six things, lines the ways to split the six into three pairs."""
    six = lambda name: spark.range(6).select(F.col("id").cast("int").alias(name))
    pairs = six("x").join(six("y"), F.col("x") < F.col("y")).select("x", "y", (F.col("x") * 6 + F.col("y")).alias("pair"))
    one, two, three = (pairs.select(F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"), F.col("pair").alias(f"p{k}")) for k in (1, 2, 3))
    apart = lambda a, b: (F.col(f"p{a}") < F.col(f"p{b}")) & (F.size(F.array_distinct(F.array(f"x{a}", f"y{a}", f"x{b}", f"y{b}"))) == 4)
    lines = one.join(two, apart(1, 2)).join(three, apart(1, 3) & apart(2, 3))
    return _members(lines.select(F.array("p1", "p2", "p3").alias("members")))


def complete_uniform(spark: SparkSession, n: int, k: int) -> DataFrame:
    """All k-subsets of n points."""
    rows = spark.range(n).select(F.array(F.col("id").cast("int")).alias("members"))
    for _ in range(k - 1):
        more = F.sequence(F.element_at("members", -1) + 1, F.lit(n))
        rows = rows.withColumn("m", F.explode(F.filter(more, lambda x: x < n))).select(F.array_append("members", F.col("m")).alias("members"))
    return _members(rows)


def loose(spark: SparkSession, edges: int, k: int, closed: bool = False) -> DataFrame:
    """A path (or cycle) of edges of size k, neighbours sharing one point."""
    step, points = k - 1, edges * (k - 1)
    at = F.sequence(F.col("id") * step, F.col("id") * step + k - 1)
    return _members(spark.range(edges).select(F.transform(at, lambda x: F.pmod(x, F.lit(points)) if closed else x).cast("array<int>").alias("members")))


def tight(spark: SparkSession, points: int, k: int, closed: bool = False) -> DataFrame:
    """The windows of k neighbouring points on a path (or cycle)."""
    at = F.sequence(F.col("id"), F.col("id") + k - 1)
    count = points if closed else points - k + 1
    return _members(spark.range(count).select(F.transform(at, lambda x: F.pmod(x, F.lit(points)) if closed else x).cast("array<int>").alias("members")))


def random_uniform(spark: SparkSession, n: int, k: int, share: float, seed: int) -> DataFrame:
    """Each k-subset of n points with a probability, by a seeded hash of its members."""
    hashed = F.pmod(F.xxhash64("members", F.lit(seed)), F.lit(1 << 30)) / F.lit(1 << 30)
    return _members(complete_uniform(spark, n, k).where(hashed < share))


def chung_lu(degrees: DataFrame, sizes: DataFrame, seed: int) -> DataFrame:
    """(e, v): constant v in fact e with probability min(1, d_v s_e / S), by a seeded hash (columns v, d and e, s).

    Only pairs that can occur are looked at together; both tables are model parameters of a bounded size.
    """
    total = sizes.agg(F.sum("s")).first()[0] or 1
    hashed = F.pmod(F.xxhash64("e", "v", F.lit(seed)), F.lit(1 << 30)) / F.lit(1 << 30)
    return sizes.join(F.broadcast(degrees), hashed < F.least(F.lit(1.0), F.col("d") * F.col("s") / F.lit(float(total)))).select("e", "v")
