"""Streaming jobs: rate windows, daily use, request counters, incremental embedding.

Sources are any streaming DataFrame; ``ts`` must be a TIMESTAMP (a zone-less
timestamp cannot carry a watermark, so it is cast).
"""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from docketry.operators import embedding
from docketry.operators.ranking import keep_best
from docketry.session import fresh_path, stage
from docketry.settings import DEFAULTS


def file_stream(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """What a folder holds under ``pattern`` as a stream, files or folders of Parquet files; the schema is read from them once.

    Columns that a table keeps in the names of its folders (``copy=0/``) are read as from a table.
    """
    path = f"{folder}/{{{pattern}}}"  # a pattern may name a file, a plain path of a stream has to be a folder
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    if not re.search(r"[][{}*?\\]", folder):  # below a pattern Spark takes no folder for the base by itself
        stream = stream.option("basePath", folder)
    return stream.parquet(path)


def timed(log: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    return log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def rate_windows(log: DataFrame, key: str, ts: str, limit: Column) -> DataFrame:
    """Requests and rejections per key and minute. Expects a watermark on ``ts``."""
    counted = log.groupBy(F.window(ts, "1 minute"), key).agg(F.count(F.lit(1)).alias("requests"))
    return counted.select(
        key, F.col("window.start").cast("timestamp_ntz").alias("minute"), "requests",
        F.greatest(F.col("requests") - limit, F.lit(0)).alias("rejected"),
    )


def daily_tokens(log: DataFrame, key: str, ts: str, tokens: str) -> DataFrame:
    """Tokens per key and day. Expects a watermark on ``ts``."""
    summed = log.groupBy(F.window(ts, "1 day"), key).agg(F.sum(tokens).alias("tokens"))
    return summed.select(key, F.to_date("window.start").alias("day"), "tokens")


def request_counters(log: DataFrame, path: str, tokens: str) -> DataFrame:
    """Running totals per path; use complete or update mode."""
    return log.groupBy(path).agg(F.count(F.lit(1)).alias("requests"), F.sum(tokens).alias("tokens"))


def start(df: DataFrame, mode: str, into: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(into) \
        .trigger(**(trigger or {"availableNow": True})).start()


def run_to_table(df: DataFrame, label: str, keys: Sequence[str], **trigger) -> DataFrame:
    """Process what is there now and return the result as a table.

    Update mode: each micro-batch writes only the rows that changed, to a folder of its
    own named by batch id, so a repeated batch replaces itself and state that the
    watermark closed is dropped. Of the rows of one key the newest batch wins.
    """
    spark = df.sparkSession
    root = fresh_path(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/data/batch={batch_id}")

    start(df, "update", write, f"{root}/state", **trigger).awaitTermination()
    wide = StructType(list(df.schema.fields)).add("batch", "long")
    result = spark.read.schema(wide).parquet(f"{root}/data")
    return keep_best(result, list(keys), [F.desc("batch")], 1).select(*df.columns)


def arriving(rows: DataFrame, slice_col: str) -> DataFrame:
    """A stream that delivers ``rows`` slice by slice, each as one micro-batch.

    Slices are written one after the other, as a file source takes files in the order of
    their times.
    """
    spark = rows.sparkSession
    root = fresh_path(spark, "arriving")
    staged = stage(rows, "slices")
    for value in sorted(r[0] for r in staged.select(slice_col).distinct().collect()):  # one number per micro-batch
        staged.where(F.col(slice_col) == value).drop(slice_col).coalesce(1).write.mode("append").parquet(root)
        time.sleep(0.01)  # file times have milliseconds
    return spark.readStream.schema(rows.drop(slice_col).schema).option("maxFilesPerTrigger", 1).parquet(root)


def collected(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """What ``plan`` gives for all that is there, in append mode; a repeated batch replaces itself."""
    spark = stream.sparkSession
    root, out = fresh_path(spark, label), plan(stream)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/data/batch={batch_id}")

    start(out, "append", write, f"{root}/state").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/data").select(*out.columns)


def embed_incrementally(chunks: DataFrame, done_path: str, embedder: Callable[[list[str]], np.ndarray], checkpoint: str,
                        dim: int = DEFAULTS.embed_dim, **trigger) -> StreamingQuery:
    """Embed chunks as they arrive; a text already embedded is not embedded again.

    The output table, keyed by content hash, is the memory: each micro-batch drops
    the hashes it holds and writes the rest to its own folder, so a retried batch
    replaces its earlier attempt. A blank or missing text has the zero vector: it would
    stop the stream for good otherwise.
    """

    # Runs with checkpoints of their own number their batches from 0 each.
    run = zlib.crc32(checkpoint.encode()) << 31

    def write(batch: DataFrame, number: int) -> None:
        spark, batch_id = batch.sparkSession, run + number
        done = existing_vectors(spark, done_path).where(F.col("batch") != batch_id)
        # A null position would lose the text of its row.
        texts = batch.withColumn("position", F.coalesce("chunk_id", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
        todo = embedding.remaining(embedding.one_per_hash(texts, "content_hash", "position", ["text"]), done, "content_hash")
        embedding.embed(todo, embedder, dim, blank_is_zero=True).write.mode("overwrite").parquet(f"{done_path}/batch={batch_id}")

    return start(chunks, "append", write, checkpoint, **trigger)


def existing_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vectors written so far; empty before the first batch."""
    schema = "content_hash string, vector array<float>, batch long"
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as exc:  # the folder appears with the first batch
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], schema)
