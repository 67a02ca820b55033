"""Bias-corrected and accelerated intervals, by rows or by clusters, and families of paired comparisons.

Resampling gives every unit (a row, or a cluster of rows that stay together) a Poisson weight in each draw from a digest of
its own name, so nothing is dealt out anew for a draw. The acceleration is that of the jackknife: a unit's leave-one-out
mean comes from its own sums and its key's, in one pass. Paired comparisons rank the sizes of differences over running
counts; for few pairs the chance of a rank sum is exact, by adding one rank after the other to the distribution of sums, for
more it is that of the normal approximation with its correction for ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.state import running_within, written
from .statistics import hashed

# The rational approximations of the normal distribution function (absolute error 1.5e-7) and of its
# inverse (relative error 1.15e-9), and the distribution function of Poisson(1).
CDF_SCALE, CDF = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
CENTRE_TOP = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
CENTRE_BOTTOM = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
TAIL_TOP = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
TAIL_BOTTOM = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
TAIL = 0.02425
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)
Z = 1.959963984540054
#: Pairs up to which the distribution of rank sums is exact.
EXACT_PAIRS = 50


def _horner(x: Column, terms: tuple) -> Column:
    out = F.lit(terms[0])
    for c in terms[1:]:
        out = out * x + c
    return out


def normal_cdf(x: Column) -> Column:
    t = 1 / (1 + CDF_SCALE * F.abs(x) / F.sqrt(F.lit(2.0)))
    tail = _horner(t, CDF[::-1]) * t * F.exp(-x * x / 2) / 2
    return F.when(x < 0, tail).otherwise(1 - tail)


def normal_quantile(p: Column) -> Column:
    q = p - 0.5
    centre = _horner(q * q, CENTRE_TOP) * q / _horner(q * q, CENTRE_BOTTOM)
    far = lambda share: _horner(F.sqrt(-2 * F.ln(share)), TAIL_TOP) / _horner(F.sqrt(-2 * F.ln(share)), TAIL_BOTTOM)
    return F.when(p < TAIL, far(p)).when(p > 1 - TAIL, -far(1 - p)).otherwise(centre)


def _interpolated(values: Column, share: Column) -> Column:
    at = share * (F.size(values) - 1)
    low = F.floor(at).cast("int")
    high = F.least(low + 1, F.size(values) - 1)
    return F.get(values, low) + (at - low) * (F.get(values, high) - F.get(values, low))


def bca_interval(df: DataFrame, key: str, value: str, unit: str, draws: int, seed: int) -> DataFrame:
    """(key, units, mean, low, high, method): the 95 % interval of each key's mean, resampled by ``unit``.

    ``method`` is "bca", "percentile" where the correction isn't defined (all draws on one side of the mean, or no spread
    of the jackknife), or "constant" where all draws are equal; null values are left out.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(key, unit).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count("*").alias("n"))
    total = rows.groupBy(key).agg(F.sum("s").alias("whole"), F.sum("n").alias("rows"), F.count("*").alias("units"))
    u = hashed(F.col(unit), F.col("_draw"), F.lit(seed)) / F.lit(float(1 << 32))
    weight = sum(F.when(u >= c, 1).otherwise(0) for c in POISSON)
    drawn = rows.withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", weight)
    means = drawn.groupBy(key, "_draw").agg(F.try_divide(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("n"))).alias("m"))
    lists = means.where("m IS NOT NULL").groupBy(key).agg(F.sort_array(F.collect_list("m")).alias("ms"))  # ``draws`` values a key
    left = rows.join(total, key).where("rows > n").select(key, ((F.col("whole") - F.col("s")) / (F.col("rows") - F.col("n"))).alias("j"))
    centre = left.groupBy(key).agg(F.avg("j").alias("c"))
    apart = F.col("c") - F.col("j")
    jack = left.join(centre, key).groupBy(key).agg(F.sum(apart * apart * apart).alias("cubes"), F.sum(apart * apart).alias("squares"))
    rows = total.join(lists, key).join(jack, key, "left").withColumn("mean", F.col("whole") / F.col("rows"))
    below = F.size(F.filter("ms", lambda m: m < F.col("mean"))) / F.size("ms")
    rows = rows.withColumn("below", below).withColumn("a", F.try_divide(F.col("cubes"), 6 * F.pow("squares", F.lit(1.5))))
    ends = F.array_max("ms"), F.array_min("ms")
    method = F.when(ends[0] == ends[1], "constant").when((F.col("below") > 0) & (F.col("below") < 1) & F.col("a").isNotNull(), "bca").otherwise("percentile")
    rows = rows.withColumn("method", method)
    # One row a key: written between the steps, since put into each other their expressions would outgrow a generated method.
    rows = written(rows.withColumn("z0", F.when(F.col("method") == "bca", normal_quantile(F.col("below")))))
    moved = lambda z: F.col("z0") + (F.col("z0") + z) / (1 - F.col("a") * (F.col("z0") + z))
    rows = written(rows.withColumn("z_low", moved(-Z)).withColumn("z_high", moved(Z)))
    share = lambda z, p: F.when(F.col("method") == "bca", normal_cdf(F.col(z))).otherwise(F.lit(p))
    rows = written(rows.withColumn("p_low", share("z_low", 0.025)).withColumn("p_high", share("z_high", 0.975)))
    low, high = _interpolated(F.col("ms"), F.col("p_low")), _interpolated(F.col("ms"), F.col("p_high"))
    flat = F.col("method") == "constant"
    return rows.select(key, "units", "mean", F.when(flat, F.col("mean")).otherwise(low).alias("low"), F.when(flat, F.col("mean")).otherwise(high).alias("high"), "method")


def holm_within(df: DataFrame, family: str, name: str, p: str) -> DataFrame:
    """``df`` with ``adjusted``: Holm's correction within each family; a family is one row a test."""
    order = Window.partitionBy(family).orderBy(p, name)
    rank, size = F.row_number().over(order), F.count("*").over(Window.partitionBy(family))
    stepped = df.withColumn("_step", F.least(F.lit(1.0), (size - rank + 1) * F.col(p)))
    return stepped.withColumn("adjusted", F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def paired_family(gaps: DataFrame) -> DataFrame:
    """(family, name, n, ties, plus, minus, biserial, exact, p, adjusted) for each comparison of (family, name, gap).

    Differences of 0 are ties and take no part; a comparison of ties only has the chance 1. ``p`` is two-sided.
    """
    keys = ["family", "name"]
    every = gaps.where("gap IS NOT NULL").groupBy(*keys).agg(F.count_if(F.col("gap") == 0).alias("ties"))
    sized = gaps.where("gap <> 0").groupBy(*keys, F.abs("gap").alias("size")).agg(F.count("*").alias("c"), F.count_if(F.col("gap") > 0).alias("up"))
    upto = running_within(sized, keys, ["size"], {"upto": "c"})
    twice = 2 * F.col("upto") - F.col("c") + 1  # twice the mean rank
    sums = upto.groupBy(*keys).agg(
        F.sum("c").alias("n"),
        F.sum(twice * F.col("up")).alias("up2"),
        F.sum(twice * (F.col("c") - F.col("up"))).alias("down2"),
        F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("tied"),
    )
    few = upto.join(sums.where(F.col("n") <= EXACT_PAIRS).select(*keys), keys)
    ranks = few.select(*keys, F.explode(F.array_repeat(twice, F.col("c").cast("int"))).alias("r")).groupBy(*keys).agg(F.sort_array(F.collect_list("r")).alias("ranks"))
    rows = every.join(sums, keys, "left").join(ranks, keys, "left").fillna(0, ["n", "up2", "down2", "tied"])
    start = F.transform(F.sequence(F.lit(0).cast("long"), F.col("up2") + F.col("down2")), lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    add = lambda chance, r: F.transform(chance, lambda p, s: (p + F.when(s >= r, F.get(chance, (s - r).cast("int"))).otherwise(0.0)) / 2)
    chance = F.aggregate("ranks", start, add)
    upper, lower = (F.aggregate(part, F.lit(0.0), lambda done, p: done + p) for part in (F.slice("chance", F.col("up2").cast("int") + 1, F.size("chance")), F.slice("chance", F.lit(1), F.col("up2").cast("int") + 1)))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tied") / 48)
    far = F.abs(F.col("up2") / 2 - n * (n + 1) / 4) / spread
    exact = F.col("n") <= EXACT_PAIRS
    p = F.when(F.col("n") == 0, 1.0).when(exact, F.least(F.lit(1.0), 2 * F.least(upper, lower))).otherwise(2 * normal_cdf(-far))
    rows = rows.withColumn("chance", F.when(exact & (F.col("n") > 0), chance)).withColumn("p", p)
    half = lambda c: (F.col(c) / 2).alias(c[:-1] if c == "up2" else "down")
    rows = rows.select(*keys, "n", "ties", half("up2"), half("down2"), exact.alias("exact"), "p")
    total = F.col("up") + F.col("down")
    rows = rows.select(*keys, "n", "ties", F.col("up").alias("plus"), F.col("down").alias("minus"), F.try_divide(F.col("up") - F.col("down"), total).alias("biserial"), "exact", "p")
    return holm_within(rows, "family", "name", "p")
