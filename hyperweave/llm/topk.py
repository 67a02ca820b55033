"""Exact top-k by inner product with the threshold algorithm over sorted per-dimension lists.

Components are made integers, floor(scale * x). The rows are dealt out evenly into shards of a bounded size; a shard
is indexed once: its values, and for each dimension the order of its rows by that component. Queries meet every shard
in blocks of a bounded size. Within a shard a query goes down all lists at once, from the large end where its own
component is positive and from the small end where it is negative, and scores each row when it first turns up, by its
whole vector. What the lists show at the depth reached gives a bound: no row unseen can score more than the sum of the
query's components times the values there. The search stops once the k-th best score is above that bound; at the bound
itself it goes on, since an unseen row could tie and have the smaller id. The depth doubles from step to step, so a
step is one array operation. Each query's best of all shards are merged by a window, which Spark cuts to k rows before
it shuffles.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do rows without
an id; vectors of different lengths do not meet. A query's own row, and any row that repeats its id, is no candidate for
it; rows that repeat an id are queries and candidates of their own. Scores are exact whole numbers; those beyond a long's
range are held at its ends and tie there.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from hyperweave.functions.state import written

SCALE, K, EVERY = 1024, 10, 100
#: Bytes of the values of a shard, and of a block of queries.
SHARD_BYTES, BLOCK_BYTES = 4 << 20, 1 << 20
#: Depth of the first step down the lists.
FIRST = 16
#: Whole numbers of this size and sums of them are exact in double precision.
EXACT = 1 << 53
LONG = (1 << 63) - 1


def scaled(vectors: list, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, as whole numbers in double precision."""
    with np.errstate(over="ignore"):
        x = np.floor(np.array(list(vectors), np.float64) * scale)
    return np.nan_to_num(x, posinf=np.finfo(float).max, neginf=-np.finfo(float).max)


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``x`` with ``q``; those beyond a long's range are held at its ends."""
    if not x.size:
        return np.zeros(len(x), np.int64)
    if float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] < EXACT:
        return (x @ q).astype(np.int64)
    return np.array([max(-LONG, min(LONG, sum(int(a) * int(b) for a, b in zip(row, q)))) for row in x], np.int64)


def lists_of(x: np.ndarray) -> np.ndarray:
    """(dims, rows): for each dimension the numbers of the rows, by rising component."""
    return np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T.astype(np.int32))


def best_of(ids: np.ndarray, x: np.ndarray, lists: np.ndarray, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores) of the k best rows for ``q``, ties to the smaller id, and how many rows were scored."""
    n = len(x)
    seen = np.zeros(n, bool)
    up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
    signed = np.concatenate((up, down))
    best, scores, depth, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, FIRST
    while depth < n:
        to = min(n, depth + step) if len(signed) else n
        new = np.zeros(n, bool)
        new[lists[up, n - to : n - depth]] = True
        new[lists[down, depth:to]] = True
        if not len(signed):
            new[:] = True
        new &= ~seen
        seen |= new
        fresh = np.flatnonzero(new & (ids != own))
        best = np.concatenate((best, fresh))
        scores = np.concatenate((scores, inner(x[fresh], q)))
        order = np.lexsort((ids[best], -scores))[:k]
        best, scores = best[order], scores[order]
        # What no unseen row can exceed in any dimension.
        edge = np.concatenate((x[lists[up, n - to], up], x[lists[down, to - 1], down]))
        if len(best) == k and len(signed) and scores[-1] > inner(edge[None], q[signed])[0]:
            break
        depth, step = to, 2 * step
    return ids[best], scores, int(seen.sum())


def top_k(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    scale: float = SCALE,
    every: int = EVERY,
    shard_bytes: int = SHARD_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose id is divisible by ``every``."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.coalesce(fine, F.lit(False)))
    rows = rows.withColumn("dims", F.size("v"))
    # A row for each length of vectors.
    sizes = {r.dims: (r.n, r.q) for r in rows.groupBy("dims").agg(F.count("*").alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q")).collect()}
    spark = vectors.sparkSession
    shape = [(d, math.ceil(n * d * 8 / shard_bytes), max(1, math.ceil(q * d * 8 / block_bytes))) for d, (n, q) in sizes.items()]
    shape = F.broadcast(spark.createDataFrame(shape, "dims int, shards long, blocks long"))
    dealt = rows.join(shape, "dims").withColumn("at", F.monotonically_increasing_id())

    def build(f: pd.DataFrame) -> pd.DataFrame:
        x = scaled(f["v"], scale)
        ids = f["vec_id"].to_numpy(np.int64)
        return pd.DataFrame(
            {"dims": f["dims"].iloc[:1], "shard": f["shard"].iloc[:1], "blocks": f["blocks"].iloc[:1], "ids": [ids.tobytes()], "x": [x.tobytes()], "lists": [lists_of(x).tobytes()]}
        )

    shards = dealt.withColumn("shard", F.pmod("at", "shards"))
    index = written(shards.groupBy("dims", "shard").applyInPandas(build, "dims int, shard long, blocks long, ids binary, x binary, lists binary"))
    queries = dealt.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("at"), "blocks"))
    queries = queries.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    queries = queries.select("dims", "shard", "block", "at", "vec_id", "v")
    there = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

    def search(shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(shard) and len(asked):
            s = shard.iloc[0]
            ids = np.frombuffer(s["ids"], np.int64)
            x = np.frombuffer(s["x"], np.float64).reshape(len(ids), -1)
            lists = np.frombuffer(s["lists"], np.int32).reshape(x.shape[1], len(ids))
            for at, own, q in zip(asked["at"], asked["vec_id"], scaled(asked["v"], scale)):
                found, scores, _ = best_of(ids, x, lists, own, q, k)
                out += [(at, own, i, score) for i, score in zip(found, scores)]
        return pd.DataFrame(out, columns=["at", "query_id", "vec_id", "score"])

    found = there.groupBy("dims", "shard", "block").cogroup(queries.groupBy("dims", "shard", "block"))
    found = found.applyInPandas(search, "at long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("at", "query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
