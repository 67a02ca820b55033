"""Tables of results: yields, frontiers, coverage, rejections, splits, and agreement of several partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.state import numbered
from .neighbours import nearest
from .statistics import hashed, quantiles


def yields(runs: DataFrame, keys: list[str], done: str, cost: str) -> DataFrame:
    """(keys, members, completed, share, median, p90): what was completed in each cell, and quantiles of its cost.

    Cells without a completed member have null quantiles.
    """
    counts = runs.groupBy(*keys).agg(F.count("*").alias("members"), F.count_if(done).alias("completed"))
    named = runs.where(done).select(F.struct(*keys).alias("_cell"), cost)
    cuts = quantiles(named, "_cell", cost, [0.5, 0.9])
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("q")))
    wide = cuts.groupBy(*[F.col(f"_cell.{k}").alias(k) for k in keys]).agg(at(0.5).alias("median"), at(0.9).alias("p90"))
    return counts.join(wide, keys, "left").withColumn("share", F.col("completed") / F.col("members"))


def frontier(cells: DataFrame, keys: list[str], size: str, censored: str, cell: str) -> DataFrame:
    """(keys, size, cell): the largest size that each key clears without a censored instance, the first such cell of ties."""
    clear = cells.where(F.col(censored) == 0)
    return clear.groupBy(*keys).agg(F.max(size).alias(size), F.max_by(cell, F.struct(F.col(size), -F.col(cell))).alias(cell))


def causes(rejections: DataFrame, keys: list[str], reason: str) -> DataFrame:
    """(keys, reason, times, share): rejections by reason, and their share among those of the same keys."""
    times = rejections.groupBy(*keys, reason).agg(F.count("*").alias("times"))
    total = times.groupBy(*keys).agg(F.sum("times").alias("_all"))
    return times.join(total, keys).withColumn("share", F.col("times") / F.col("_all")).drop("_all")


def coverage(design: DataFrame, measured: DataFrame, keys: list[str], seed: str, expected: int) -> DataFrame:
    """(keys, seeds, status): how many of the expected seeds each cell of the design was measured with."""
    seeds = measured.groupBy(*keys).agg(F.countDistinct(seed).alias("seeds"))
    rows = design.join(seeds, keys, "left").withColumn("seeds", F.coalesce("seeds", F.lit(0)))
    status = F.when(F.col("seeds") == 0, "absent").when(F.col("seeds") < expected, "partial").otherwise("complete")
    return rows.withColumn("status", status)


def several_tags(rows: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """(keys, tags): the cells that were measured under more than one tag."""
    return rows.groupBy(*keys).agg(F.countDistinct(tag).alias("tags")).where("tags > 1")


def common_members(rows: DataFrame, member: str, arm: str, out: DataFrame | None = None) -> DataFrame:
    """(member): the members that every arm kept, without those of ``out``."""
    arms = F.broadcast(rows.agg(F.countDistinct(arm).alias("_arms")))  # one row
    kept = rows.groupBy(member).agg(F.countDistinct(arm).alias("_n")).join(arms).where("_n = _arms").select(member)
    return kept if out is None else kept.join(out.select(member), member, "left_anti")


def added(proposal: DataFrame, base: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, item, times): what a proposal holds beyond its base, as multisets."""
    count = lambda df, name: df.groupBy(*keys, item).agg(F.count("*").alias(name))
    both = count(proposal, "_new").join(count(base, "_old"), [*keys, item], "left")
    return both.withColumn("times", F.col("_new") - F.coalesce("_old", F.lit(0))).where("times > 0").select(*keys, item, "times")


def split(rows: DataFrame, id_col: str, label: str, share: float, seed: int) -> DataFrame:
    """``rows`` with ``train``: a share of each label in a seeded order, halves to the even number and one at least.

    Null labels are a label of their own.
    """
    shuffled = rows.withColumn("_label", F.coalesce(F.col(label).cast("string"), F.lit(""))).withColumn("_h", hashed(F.col(id_col), F.lit(seed)))
    sizes = shuffled.groupBy("_label").agg(F.count("*").alias("_all"))
    dealt = numbered(shuffled, ["_label"], ["_h", id_col], "_at").join(sizes, "_label")
    cut = F.greatest(F.bround(F.col("_all") * share), F.lit(1))
    return dealt.withColumn("train", F.col("_at") < cut).select(*rows.columns, "train")


def subsample(rows: DataFrame, id_col: str, label: str, most: int, seed: int) -> DataFrame:
    """At most ``most`` of ``rows``, the same number of each label, in a seeded order; all if there are no more.

    This is a sampling operator: its bound is what it is for. Null labels are a label of their own.
    """
    shuffled = rows.withColumn("_label", F.coalesce(F.col(label).cast("string"), F.lit(""))).withColumn("_h", hashed(F.col(id_col), F.lit(seed)))
    dealt = numbered(shuffled, ["_label"], ["_h", id_col], "_at")
    sizes = F.broadcast(rows.agg(F.count("*").alias("_all"), F.countDistinct(F.coalesce(F.col(label).cast("string"), F.lit(""))).alias("_labels")))  # one row
    quota = F.greatest(F.floor(F.lit(most) / F.col("_labels")), F.lit(1))
    kept = dealt.join(sizes).where((F.col("_all") <= most) | (F.col("_at") < quota))
    # More labels than ``most``: one row each is still too many.
    last = numbered(kept, [], ["_h", id_col], "_rank").where((F.col("_all") <= most) | (F.col("_rank") < most))
    return last.select(*rows.columns)


def most_frequent_type(types: DataFrame, entity: str, kind: str) -> DataFrame:
    """(entity, type, carriers): each entity's type that most entities carry, ties by the least type."""
    rows = types.select(entity, kind).where(F.col(kind).isNotNull()).distinct()
    carriers = rows.groupBy(kind).agg(F.count("*").alias("carriers"))
    best = F.min(F.struct((-F.col("carriers")).alias("c"), F.col(kind).alias("t"))).alias("b")
    return rows.join(carriers, kind).groupBy(entity).agg(best).select(entity, F.col("b.t").alias("type"), (-F.col("b.c")).alias("carriers"))


def agreement_of_partitions(parts: DataFrame) -> DataFrame:
    """(a, b, items, ari): adjusted agreement of every two methods' partitions (columns item, method, class).

    Methods are few; items meet by their id, and everything after that is counts of classes.
    """
    one = parts.select("item", F.col("method").alias("a"), F.col("class").alias("x"))
    two = parts.select("item", F.col("method").alias("b"), F.col("class").alias("y"))
    both = one.join(two, "item").where("a < b").groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / F.lit(2.0).cast("double"))
    side = lambda c, name: both.groupBy("a", "b", c).agg(F.sum("n").alias("n")).groupBy("a", "b").agg(pairs("n").alias(name))
    sums = both.groupBy("a", "b").agg(pairs("n").alias("s"), F.sum("n").alias("items")).join(side("x", "p"), ["a", "b"]).join(side("y", "q"), ["a", "b"])
    all_pairs = F.col("items") * (F.col("items") - 1) / F.lit(2.0).cast("double")
    chance = F.try_divide(F.col("p") * F.col("q"), all_pairs)
    ari = F.try_divide(F.col("s") - chance, (F.col("p") + F.col("q")) / 2 - chance)
    return sums.select("a", "b", "items", F.coalesce(ari, F.lit(1.0)).alias("ari"))


def exact_ceiling(rows: DataFrame, key: str, code: str) -> DataFrame:
    """One row (items, alone, ceiling): the most a nearest neighbour by a complete invariant can get right.

    An item with equal others is right with the share of them in its class, any other one always; counted from class
    sizes, never by pairs.
    """
    each = rows.groupBy(key, code).agg(F.count("*").alias("own"))
    size = each.groupBy(key).agg(F.sum("own").alias("n"))
    right = F.when(F.col("n") == 1, 1.0).otherwise(F.col("own") * (F.col("own") - 1) / (F.col("n") - 1))
    return each.join(size, key).agg(
        F.sum("own").alias("items"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("alone"), (F.sum(right) / F.sum("own")).alias("ceiling")
    )


def error_split(probabilities: DataFrame, group: Column, other: Column) -> DataFrame:
    """One row (within, other, share) from (i, li, lj, p): expected errors inside the query's group and outside it.

    ``group`` and ``other`` give the groups of li and lj; the share is null without errors.
    """
    wrong, same = F.col("li") != F.col("lj"), group == other
    mass = lambda c: F.coalesce(F.sum(F.when(c, F.col("p"))), F.lit(0.0))
    sums = probabilities.agg(F.countDistinct("i").alias("n"), mass(wrong & same).alias("w"), mass(~same).alias("o"))
    return sums.select(
        F.try_divide("w", "n").alias("within"), F.try_divide("o", "n").alias("other"), F.try_divide(F.col("w"), F.col("w") + F.col("o")).alias("share")
    )


def neighbour_graph(dist: DataFrame, k: int) -> DataFrame:
    """(a, b): undirected edges, a < b, of the k nearest of each query."""
    near = nearest(dist, k)
    return near.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def word_sizes(shape: DataFrame) -> DataFrame:
    """(hg, word_length, pointers, alphabet, bits) from (hg, n, m, max_arity): length of the fact word, the pointers
    that a program needs, its alphabet, and the bits of a word of that length over it."""
    k = F.greatest(F.lit(2).cast("long"), "max_arity")
    rows = shape.select("hg", (F.col("n") + F.col("m")).alias("word_length"), k.alias("pointers"))
    alphabet = (F.col("pointers") * (F.col("pointers") - 1) / 2 + 3 * F.col("pointers") + 1).cast("long")
    return rows.withColumn("alphabet", alphabet).withColumn("bits", F.col("word_length") * F.log2("alphabet"))


def slots(tokens: DataFrame, slot: str, token: str) -> DataFrame:
    """(slot, symbols): different symbols seen at each slot."""
    return tokens.groupBy(slot).agg(F.countDistinct(token).alias("symbols"))


def mean_ratios(rows: DataFrame, id_col: str, order: str, value: str) -> DataFrame:
    """(id, steps, geomean): geometric mean of the ratios of each positive value to the one before it."""
    before = F.lag(value).over(Window.partitionBy(id_col).orderBy(order))
    ratios = rows.where(F.col(value) > 0).select(id_col, (F.col(value) / before).alias("r")).where("r IS NOT NULL")
    return ratios.groupBy(id_col).agg(F.count("*").alias("steps"), F.exp(F.avg(F.ln("r"))).alias("geomean"))
