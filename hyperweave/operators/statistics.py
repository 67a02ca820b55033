"""Statistics over tables: corrections for many tests, signed ranks, trends, bins and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.state import numbered, running, running_within


def holm(df: DataFrame, name: str, p: str) -> DataFrame:
    """(name, p, rank, adjusted): Holm's step-down correction; a family of tests is one row a test."""
    order = Window.orderBy(p, name)
    rows = df.select(name, p, F.row_number().over(order).alias("rank"), F.count("*").over(Window.partitionBy()).alias("m"))
    step = F.least(F.lit(1.0), (F.col("m") - F.col("rank") + 1) * F.col(p))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(name, p, "rank", F.max(step).over(upto).alias("adjusted"))


def signed_ranks(df: DataFrame, gap: str) -> DataFrame:
    """One row (n, plus, minus, biserial): signed-rank sums of the differences other than 0, ties by mean rank."""
    sized = df.where(F.col(gap) != 0).groupBy(F.abs(gap).alias("size")).agg(F.count("*").alias("c"), F.count_if(F.col(gap) > 0).alias("up"))
    upto = running(sized, ["size"], {"upto": "c"})
    rank = F.col("upto") - (F.col("c") - 1) / F.lit(2.0).cast("double")
    sums = upto.agg(F.sum("c").alias("n"), F.sum(rank * F.col("up")).alias("plus"), F.sum(rank * (F.col("c") - F.col("up"))).alias("minus"))
    return sums.withColumn("biserial", F.try_divide(F.col("plus") - F.col("minus"), F.col("plus") + F.col("minus")))


def monotone_share(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, steps, share): the share of steps that go up within each key."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(order))
    rows = df.select(key, step.alias("step")).where("step IS NOT NULL")
    return rows.groupBy(key).agg(F.count("*").alias("steps"), F.avg((F.col("step") > 0).cast("int")).alias("share"))


def heavy_tail(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, q1, q3, share): the share beyond the third quartile plus one and a half times the quartiles' gap."""
    cuts = quantiles(df, key, value, [0.25, 0.75]).groupBy(key).agg(
        F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q1"), F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q3")
    )
    rows = df.join(cuts, key)
    beyond = F.col(value) > F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    return rows.groupBy(key, "q1", "q3").agg(F.avg(beyond.cast("int")).alias("share"))


def quantiles(df: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """(key, p, q): quantiles of each key with linear interpolation, from running counts of the distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    upto = running_within(counts, [key], [value], {"_upto": "_n"})
    totals = counts.groupBy(key).agg(F.sum("_n").alias("_t"))
    ends = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(up).alias("up")) for p in shares for up in (0, 1)]))
    at = F.col("e.p") * (F.col("_t") - 1)
    place = F.least(F.floor(at) + F.col("e.up"), F.col("_t") - 1)
    wanted = upto.join(totals, key).withColumn("e", ends).where((place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_n")))
    part = at - F.floor(at)
    weight = F.when(F.col("e.up") == 1, part).otherwise(1 - part)
    return wanted.groupBy(key, F.col("e.p").alias("p")).agg(F.sum(weight * F.col(value)).alias("q"))


def power_law(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (slope, intercept, r2) of the least-squares line through the logarithms of positive values."""
    logs = df.where((F.col(x) > 0) & (F.col(y) > 0)).select(F.log10(x).alias("lx"), F.log10(y).alias("ly"))
    return logs.agg(F.regr_slope("ly", "lx").alias("slope"), F.regr_intercept("ly", "lx").alias("intercept"), F.regr_r2("ly", "lx").alias("r2"))


def binned_information(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """One row (bits): mutual information of two columns on a grid of equal bins."""
    ends = F.broadcast(df.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))]))  # one row

    def cell(c: str) -> Column:
        width = (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / bins
        return F.when(width > 0, F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / width), F.lit(bins - 1))).otherwise(F.lit(0))

    both = df.join(ends).select(cell(x).alias("i"), cell(y).alias("j")).groupBy("i", "j").agg(F.count("*").alias("n"))
    one, two = both.groupBy("i").agg(F.sum("n").alias("ni")), both.groupBy("j").agg(F.sum("n").alias("nj"))
    total = F.broadcast(both.agg(F.sum("n").cast("double").alias("t")))
    p = F.col("n") / F.col("t")
    return both.join(one, "i").join(two, "j").join(total).agg(F.sum(p * F.log2(F.col("n") * F.col("t") / (F.col("ni") * F.col("nj")))).alias("bits"))


def hashed(*parts: Column) -> Column:
    """A number from 0 to 2^32 - 1 from a digest of the parts' text, the same on every run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def bootstrap_mean(df: DataFrame, key: str, value: str, row: str, draws: int, seed: int) -> DataFrame:
    """(key, mean, low, high): percentile interval of the mean by Poisson resampling, whose weights need no row numbers.

    Each row gets a Poisson(1) weight in each draw from a digest of its own key ``row`` and the draw, so no row moves;
    rows with equal values share their draws' sums only after that, partially aggregated for each draw.
    """
    u = hashed(F.col(row), F.col("_draw"), F.lit(seed)) / F.lit(float(1 << 32))
    steps = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]  # fixed values: Poisson(1) distribution function
    weight = sum(F.when(u >= c, 1).otherwise(0) for c in steps)
    rows = df.select(key, value, row).withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    means = rows.withColumn("w", weight).groupBy(key, "_draw").agg(F.try_divide(F.sum(F.col("w") * F.col(value)), F.sum("w")).alias("m"))
    ends = means.groupBy(key).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))  # ``draws`` values a key
    own = df.groupBy(key).agg(F.avg(value).alias("mean"))
    return own.join(ends, key).select(key, "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def folds(df: DataFrame, id_col: str, label: str, k: int, seed: int) -> DataFrame:
    """``df`` with ``fold``: rows of each label dealt evenly in a seeded order, over running counts without one task for a label."""
    shuffled = df.withColumn("_h", hashed(F.col(id_col), F.lit(seed)))
    dealt = numbered(shuffled, [label], ["_h", id_col], "_at")
    return dealt.withColumn("fold", F.pmod(F.col("_at"), F.lit(k)).cast("int")).select(*df.columns, "fold")
