"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents of a source are put in a seeded random order and cut into blocks of equal
words. A source's quota is a number of blocks, its whole blocks repeated as often as its
target asks. The quotas of all sources are split among the output shards down a binary
tree: each node draws, without replacement, how many blocks of every source its left half
gets, so quotas are met exactly and every shard holds a random mix. A shard walks from
the root to its own leaf with the random numbers of the nodes on that path, so no node is
computed centrally. Blocks are dealt to the shards' disjoint ranges through a seeded
permutation, and rows are shuffled inside a shard by a hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.llm.quality_rules import words_of
from docketry.session import stage


@dataclass(frozen=True)
class Mix:
    """``repeat``: most copies of a document; the rest sets sizes of work, not results' meaning."""

    seed: int = 17
    repeat: int = 3
    least_blocks: int = 1024
    block_words: int = 65_536
    shard_words: int = 4_194_304
    bin_docs: int = 4_096
    #: The table of sources is read by every task; a larger one is refused.
    max_sources: int = 200_000


def source_targets(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per source: number, weight, words and target.

    Sources in code point order, null last, weigh 1, 2, 3, repeating. All words are
    shared by weight; a source gets at most ``repeat`` times its own, and what it cannot
    take is shared among the rest: with sources ordered by the level at which they fill
    up, the filled ones are the first few.
    """
    every = Window.partitionBy(F.lit(1))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    numbered = totals.withColumn("source_no", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = numbered.withColumns({
        "weight": F.col("source_no") % 3 + 1, "cap": F.col("source_size") * F.lit(mix.repeat), "all_words": F.sum("source_size").over(every),
    })
    filling = every.orderBy(F.col("cap") / F.col("weight"), "source_no")
    level = (F.col("all_words") - (F.sum("cap").over(filling) - F.col("cap"))) / (
        F.sum("weight").over(every) - F.sum("weight").over(filling) + F.col("weight")
    )
    full = weighed.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    common = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * common)
    blocks = F.greatest(F.lit(mix.least_blocks), F.ceil(F.col("source_size") / mix.block_words))
    return full.withColumn("target", target.cast("double")).withColumn("n_blocks", blocks).select(
        "source", "source_no", "source_size", "n_docs", "target", "n_blocks",
        F.ceil(F.col("n_docs") / mix.bin_docs).alias("n_bins"),
        F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * F.col("n_blocks")))
        .otherwise(0).cast("long").alias("quota"),
    )


def _leaf_counts(quotas: np.ndarray, shard: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """How many blocks of each source the shard gets, and how many lie in shards before it."""
    total = int(quotas.sum())
    counts, before = quotas.astype(np.int64), np.zeros(len(quotas), np.int64)
    low, high = 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        room = total * middle // shards - total * low // shards
        left = np.random.default_rng((seed, low, high)).multivariate_hypergeometric(counts, room, method="marginals")
        if shard < middle:
            counts, high = left, middle
        else:
            counts, before, low = counts - left, before + left, middle
    return counts, before


def _spread(quota: int) -> int:
    """A step near the golden section of ``quota`` that visits every draw once."""
    step = max(1, int(quota * 0.6180339887498949))
    while math.gcd(step, quota) != 1:
        step += 1
    return step


def block_draws(sources: list, spark, mix: Mix) -> DataFrame:
    """One row per drawn block: source_no, block, turn (0 for its first copy), shard."""
    quotas = np.array([s["quota"] for s in sources], np.int64)
    numbers = np.array([s["source_no"] for s in sources], np.int64)
    steps = np.array([_spread(max(1, int(q))) for q in quotas], np.int64)
    blocks = np.array([s["n_blocks"] for s in sources], np.int64)
    words = sum(s["target"] for s in sources)
    shards = max(1, math.ceil(words / mix.shard_words))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                counts, before = _leaf_counts(quotas, int(shard), shards, mix.seed)
                some = counts > 0
                yield pd.DataFrame({
                    "shard": int(shard), "source_no": numbers[some], "first": before[some], "n": counts[some],
                    "quota": quotas[some], "step": steps[some], "n_blocks": blocks[some],
                })

    leaves = spark.range(0, shards, 1, min(shards, 1000)).mapInPandas(
        walk, "shard long, source_no long, first long, n long, quota long, step long, n_blocks long",
    )
    drawn = leaves.select(
        "shard", "source_no", "quota", "step", "n_blocks",
        F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("j"),
    ).withColumn("draw", F.pmod(F.col("j") * F.col("step") + F.lit(mix.seed), F.col("quota")))
    return drawn.select(
        "source_no", (F.col("draw") % F.col("n_blocks")).alias("block"),
        F.floor(F.col("draw") / F.col("n_blocks")).alias("turn"), "shard",
    )


def mix_sources(
    docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """The documents with their sizes and targets, and the mix: one row per copy taken.

    The first table has a row per input row (at, doc_id, source_no, size, source_size,
    target), the second (at, doc_id, size, turn, shard, place); ``at`` is the row's place
    in ``docs``, which has to be re-readable in the same order (a scan or a checkpoint).
    A null text has size 0, a null source is a source of its own, repeated rows are rows
    like others, an empty table gives empty results. A source's taken words differ from
    its target by half a block and half a document at most.
    """
    spark = docs.sparkSession
    sized = stage(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.size(words_of(F.coalesce(F.col(text_col), F.lit("")))).cast("long").alias("size"),
        F.xxhash64(F.lit(mix.seed), F.col(id_col), F.col(text_col)).alias("key"), F.monotonically_increasing_id().alias("at"),
    ), "mix-sizes")
    sources = stage(source_targets(sized, mix), "mix-sources")
    n_sources = sources.count()
    if n_sources > mix.max_sources:
        raise ValueError(f"{n_sources} sources; at most {mix.max_sources} can be mixed")
    known = F.broadcast(sources.withColumnRenamed("source", "_source"))  # at most max_sources rows
    share = F.col("key") / F.lit(2.0**64) + 0.5
    placed = sized.join(known, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "bin", F.least(F.floor(share * F.col("n_bins")), F.col("n_bins") - 1),
    )
    # Running sums in two steps, so that no window holds a whole source's documents.
    bins = placed.groupBy("source_no", "bin").agg(F.sum("size").alias("in_bin"))
    before = bins.select(
        "source_no", "bin",
        (F.sum("in_bin").over(Window.partitionBy("source_no").orderBy("bin")) - F.col("in_bin")).alias("before"),
    )
    inside = Window.partitionBy("source_no", "bin").orderBy("key", "at").rowsBetween(Window.unboundedPreceding, 0)
    ordered = placed.withColumn("upto", F.sum("size").over(inside)).join(before, ["source_no", "bin"])
    centre = F.col("before") + F.col("upto") - F.col("size") / 2
    block = F.when(
        F.col("source_size") > 0, F.least(F.floor(centre * F.col("n_blocks") / F.col("source_size")), F.col("n_blocks") - 1),
    ).otherwise(0)
    rows = ordered.select("at", "doc_id", "source_no", "size", "source_size", "target", block.cast("long").alias("block"))
    draws = block_draws(sources.collect(), spark, mix)
    taken = rows.join(draws, ["source_no", "block"]).select(
        "at", "doc_id", "size", "turn", "shard", F.xxhash64(F.lit(mix.seed), "shard", "doc_id", "at", "turn").alias("place"),
    )
    return rows.drop("block"), taken


def taken_words(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target and the words taken of it."""
    rows, taken = mix_sources(docs, mix)
    copies = taken.groupBy("at").agg(F.sum("size").alias("taken"))
    return rows.join(copies, "at", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
    )


def mixed_rows(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, shard by shard in shuffled order."""
    _, taken = mix_sources(docs, mix)
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("at"))
    return (
        marked.join(taken.select("at", "shard", "place"), "at")
        .repartition("shard").sortWithinPartitions("shard", "place").select("row.*")
    )
