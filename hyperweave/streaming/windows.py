"""Structured Streaming over an event table: windowed counts with a watermark, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.state import cut

LATE = "2 days"


def windowed_counts(events: DataFrame, key: str, ts: str, width: str) -> DataFrame:
    """(key, start, n) of a batch or a stream; a stream closes a window once the watermark has passed it."""
    rows = events.withWatermark(ts, LATE) if events.isStreaming else events
    return rows.groupBy(F.col(key).alias("key"), F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).select("key", "w.start", "n")


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isDirectory()


def run_stream(spark: SparkSession, path: str, key: str, ts: str, width: str) -> DataFrame:
    """The stream over the Parquet files of ``path`` as it stands, with its last rows for each window.

    The query checkpoints in the shared folder and writes Parquet there; a restart goes on from its offsets.
    """
    schema = spark.read.parquet(path).schema
    cut(spark.range(1))  # sets the shared folder where none is
    root = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema)
    parent, _, name = path.rstrip("/").rpartition("/")
    # A stream reads folders only: a table of part files is one, a single file is picked in its parent by name.
    stream = stream.parquet(path) if _is_folder(spark, path) else stream.option("pathGlobFilter", name).parquet(parent + "/")
    out = windowed_counts(stream.withColumn(ts, F.col(ts).cast("timestamp")), key, ts, width)
    done = (
        out.writeStream.outputMode("update")
        .foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{root}/out/batch={n}"))
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .start()
    )
    done.awaitTermination()
    last = F.max_by("n", "batch").alias("n")
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/out").groupBy("key", "start").agg(last)
