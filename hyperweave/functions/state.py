"""Checkpoints in the shared folder, and running totals over the whole of an ordered table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: A key is hot if it holds more than one in so many rows; so many keys are hot at most.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: computed once, and safe from lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``cut`` by a table in the shared folder: loops go on from it without what is known of the plan so far, which
    a checkpoint keeps and which grows from round to round."""
    path = f"{shared_dir(df.sparkSession)}/state-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_keys(rows: DataFrame, keys: list[str], total: int | None = None) -> DataFrame | None:
    """The keys that hold more than one in HOT_SHARE rows (so HOT_SHARE of them at most), None if there are none.

    ``total`` is the number of rows, where it is known.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = rows.count() if total is None else total
    found = counts.where(F.col("_n") > total / HOT_SHARE).select(*keys).collect()
    return rows.sparkSession.createDataFrame(found, counts.select(*keys).schema) if found else None


def look_up(rows: DataFrame, keys: list[str], table: DataFrame, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key.

    The rows of hot keys meet a broadcast copy of the table's rows for them, HOT_SHARE at most, where they are; all
    others are dealt out by key, so no task gets more than a small share of the rows for one key.
    """
    if hot is None:
        return rows.join(table, keys, how)
    few = F.broadcast(hot)
    known = F.broadcast(table.join(few, keys, "left_semi"))
    there = rows.join(few, keys, "left_semi").join(known, keys, how)
    return there.unionByName(rows.join(few, keys, "left_anti").join(table, keys, how))


def running(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """``df`` with, for each ``name: column`` of ``sums``, the sum of the column over this row and all before it.

    Rows are dealt out by ranges of ``order`` and summed within each range; the ranges' totals, one row each, are
    summed in turn. No task sees the whole table. The order must be total for a defined result.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for n, c in sums.items():
        ranged = ranged.withColumn(f"_w_{n}", F.sum(c).over(within))
    out = ranged.join(F.broadcast(offsets), "_part")  # one row for each range
    return out.select(*df.columns, *[(F.col(f"_w_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def running_within(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """``running`` that starts anew for each key; one key's rows may lie in many ranges."""
    upto = running(df, [*keys, *order], sums)
    start = upto.groupBy(*keys).agg(*[F.min(F.col(n) - F.col(c)).alias(f"_s_{n}") for n, c in sums.items()])
    out = upto.join(start, keys)
    return out.select(*df.columns, *[(F.col(n) - F.col(f"_s_{n}")).alias(n) for n in sums])


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with its rows numbered from 0 within each key (over the whole table without keys), in a total order."""
    one = df.withColumn("_one", F.lit(1))
    upto = running_within(one, keys, order, {name: "_one"}) if keys else running(one, order, {name: "_one"})
    return upto.withColumn(name, (F.col(name) - 1).cast("long")).drop("_one")
