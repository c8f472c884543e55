"""Vectors for texts as they arrive, with a memory of what is done that is not read in full.

Under ``path`` a micro-batch writes folders of its own number: ``keys`` (content hashes)
and ``vectors``, both in folders by a prefix of the hash, and ``blooms``, bit sets of its
hashes for each prefix. A later batch opens the bit sets of the prefixes it touches; only
hashes whose bits are all set are compared with keys, and only in their prefixes' folders.
Vectors already written are never read.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docketry.operators.embedding import one_per_hash
from docketry.session import stage
from docketry.streaming.jobs import start

#: Folders by hash prefix, bits of a prefix's set, and bits that a hash sets.
PARTS, BITS, MARKS = 16, 1 << 22, 4
SHAPES = {
    "keys": "content_hash string, batch long, part int", "vectors": "content_hash string, vector array<double>, batch long, part int",
    "blooms": "bucket long, bits binary, batch long, part int",
}


def part_of(content_hash: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(content_hash, 1, 4)), F.lit(PARTS)).cast("int")


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of earlier batches; empty before the first."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], SHAPES[name])
    return spark.read.schema(SHAPES[name]).parquet(f"{path}/{name}")


def _marks(rows: DataFrame) -> DataFrame:
    """A row per hash and bit: part, content_hash, bucket of the bit set, place in it."""
    bits = F.array(*[F.pmod(F.xxhash64("content_hash", F.lit(i)), F.lit(BITS)) + 1 for i in range(MARKS)])
    bit = rows.select("part", "content_hash", F.explode(F.array_distinct(bits)).alias("bit"))
    return bit.select("part", "content_hash", F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").alias("place"))


def unknown(rows: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Rows (part, content_hash, ...) that no other batch under ``path`` has done."""
    spark = rows.sparkSession
    parts = [r[0] for r in rows.select("part").distinct().collect()]  # at most PARTS
    earlier = lambda name, some: _read(spark, path, name).where(F.col("part").isin(some) & (F.col("batch") != batch_id))
    sets = earlier("blooms", parts).groupBy("part", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.shiftright("place", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit_set = F.call_function("shiftright", byte, F.col("place").bitwiseAND(7).cast("int")).bitwiseAND(F.lit(1)) == 1
    met = _marks(rows).join(sets, ["part", "bucket"], "left").groupBy("part", "content_hash").agg(F.min(F.coalesce(bit_set, F.lit(False))).alias("maybe"))
    marked = stage(rows.join(met, ["part", "content_hash"]), "maybe-done")
    open_parts = [r[0] for r in marked.where("maybe").select("part").distinct().collect()]
    fresh = marked.where(~F.col("maybe"))
    if open_parts:
        keys = earlier("keys", open_parts).select("part", "content_hash")
        fresh = fresh.unionByName(marked.where("maybe").join(keys, ["part", "content_hash"], "left_anti"))
    return fresh.drop("maybe")


def vectors_incrementally(chunks: DataFrame, vectors: DataFrame, key: str, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Give every new content hash of a stream (chunk_id, content_hash, <key>) its vector.

    ``vectors`` (<key>, vector) holds them; of the chunks of one hash in a batch the smallest
    chunk_id decides. Hashes without a vector stay open and are tried again when they come
    again. A repeated micro-batch replaces what it wrote.
    """

    # Runs with checkpoints of their own number their batches from 0 each.
    run = zlib.crc32(checkpoint.encode()) << 31

    def write(batch: DataFrame, number: int) -> None:
        batch_id = run + number
        firsts = one_per_hash(batch.withColumn("position", F.col("chunk_id")), "content_hash", "position", [key])
        todo = stage(firsts.withColumn("part", part_of(F.col("content_hash"))), "arrived")
        fresh = unknown(todo, path, batch_id)
        made = stage(fresh.join(vectors.select(key, F.col("vector").cast("array<double>").alias("vector")), key).select("content_hash", "vector", "part"), "new-vectors")
        if made.isEmpty():
            return
        made.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/vectors/batch={batch_id}")
        bits = _marks(made).select("part", "bucket", "place").groupBy("part", "bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
        bits.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/blooms/batch={batch_id}")
        # Keys last: what they name is there.
        made.select("content_hash", "part").repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/keys/batch={batch_id}")

    return start(chunks, "append", write, checkpoint, **trigger)


def vectors_of(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "vectors").select("content_hash", "vector")
