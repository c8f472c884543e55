"""Embedding bookkeeping: what is missing, what it costs, how results fan out."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import count_tokens
from docketry.functions.vectors import unit
from docketry.operators.dedup import one_per_hash
from docketry.operators.joins import salted_join
from docketry.settings import DEFAULTS


def hashing_embedder(dim: int = DEFAULTS.embed_dim) -> Callable[[list[str]], np.ndarray]:
    """Deterministic stand-in for a remote model: hashed words, signed, unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in enumerate(texts):
            for word in text.split():
                digest = hashlib.blake2b(word.encode("utf-8"), digest_size=8).digest()
                slot = int.from_bytes(digest, "little")
                out[row, slot % dim] += 1.0 if slot >> 63 else -1.0
            length = np.linalg.norm(out[row])
            if length:
                out[row] /= length
        return out

    return embed


def valid_cache(cache: DataFrame, dim: int = DEFAULTS.embed_dim) -> DataFrame:
    """Cache entries in force: the last line per hash among those of the right size."""
    sized = cache.where(F.size("vector") == dim)
    return sized.groupBy("content_hash").agg(F.max_by("vector", "seq").alias("vector"))


def missing(chunks: DataFrame, cache: DataFrame, order: str = "position") -> DataFrame:
    """One row per content hash that has no cached vector, with its member count."""
    todo = chunks.join(cache.select("content_hash"), "content_hash", "left_anti")
    return one_per_hash(todo, "content_hash", order, ["text"])


def remaining(chunks: DataFrame, done: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows whose key is not in ``done``."""
    return chunks.join(done.select(key), key, "left_anti")


def embed(rows: DataFrame, embedder: Callable[[list[str]], np.ndarray], dim: int = DEFAULTS.embed_dim,
          blank_is_zero: bool = False) -> DataFrame:
    """``content_hash, vector`` for every row; a blank text or a wrong size fails the job.

    With ``blank_is_zero`` a blank text, but no null, has the zero vector and is not embedded.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            worded = (pdf["text"].str.strip() != "").to_numpy(dtype=bool)
            if pdf["text"].isna().any() or not (blank_is_zero or worded.all()):
                raise ValueError("texts to embed must not be blank")
            vectors = np.zeros((len(pdf), dim))
            if worded.any():
                made = embedder(pdf["text"][worded].tolist())
                if made.shape != (worded.sum(), dim):
                    raise ValueError(f"embedder returned shape {made.shape}, wanted ({worded.sum()}, {dim})")
                vectors[worded] = made
            yield pd.DataFrame({
                "content_hash": pdf["content_hash"].to_numpy(), "vector": list(vectors.astype(np.float32)),
            })

    return rows.select("content_hash", "text").mapInPandas(run, "content_hash string, vector array<float>")


def fan_out(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """``chunk_id, vector`` for every chunk whose hash has a vector.

    A text repeated across a large share of the corpus is one hash; its rows are
    spread out before the join.
    """
    return salted_join(
        chunks.select("chunk_id", "content_hash"), vectors.select("content_hash", "vector"),
        "content_hash", spread_on=["chunk_id"],
    ).select("chunk_id", "vector")


def estimate(chunks: DataFrame, cache: DataFrame, price: float = DEFAULTS.price_per_million,
             discount: float = DEFAULTS.batch_discount) -> DataFrame:
    """One row: chunk counts, tokens of the unique misses and the batch price."""
    cached = cache.select("content_hash").distinct().withColumn("hit", F.lit(1))
    flagged = chunks.join(cached, "content_hash", "left")
    per_hash = flagged.groupBy("content_hash").agg(
        F.count(F.lit(1)).alias("n"), F.max("hit").alias("hit"),
        # Members of a hash share their text, so any of them gives its size.
        F.max(count_tokens(F.col("text"))).cast("long").alias("tokens"),
    )
    miss = F.col("hit").isNull()
    return per_hash.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"),
        F.coalesce(F.sum(F.when(~miss, F.col("n"))), F.lit(0)).alias("n_cached"),
        F.count_if(miss).alias("n_unique_misses"),
        F.coalesce(F.sum(F.when(miss, F.col("tokens"))), F.lit(0)).alias("total_tokens"),
    ).withColumn("est_usd", F.round(F.col("total_tokens") / 1_000_000 * price * discount, 4))


def check_cost(estimate_row: dict, confirm: bool) -> None:
    """Refuse a paid run that was not confirmed."""
    if estimate_row["n_unique_misses"] and not confirm:
        raise PermissionError("cost gate: confirm the estimate before submitting")


def index_rows(chunks: DataFrame, vectors: DataFrame, dim: int = DEFAULTS.embed_dim) -> DataFrame:
    """Searchable rows: chunks with a vector of the right size, unit length, grade B dropped."""
    sized = vectors.where(F.size("vector") == dim)
    kept = chunks.where(~F.col("payload.trust_grade").eqNullSafe("B"))
    return kept.join(sized, "chunk_id").withColumn("vector", unit(F.col("vector")).cast("array<float>"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "point_id") -> DataFrame:
    """Keyed overwrite: incoming rows replace existing rows of the same key."""
    kept = existing.join(incoming.select(key), key, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)
