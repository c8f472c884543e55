"""Counts over sources, documents, chunks and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import strip


def corpus_stats(docs: DataFrame) -> DataFrame:
    """Documents, articles and metadata-only documents per type and kind, with regions."""
    return docs.groupBy("doc_type", F.coalesce("law_kind", F.lit("(미상)")).alias("law_kind")).agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum(F.size("articles")).alias("articles"),
        F.count_if(F.col("trust_grade") == "B").alias("grade_b"),
        F.count_distinct("jurisdiction").alias("regions"),
    )


def chunk_stats(docs: DataFrame, chunks: DataFrame, max_tokens: int) -> DataFrame:
    """One row: documents read and kept, duplicates, chunks, chunks over the limit."""
    read = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("docs"), F.count(F.lit(1)).alias("parents"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_docs"),
    )
    total = chunks.agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("n_tokens") > max_tokens).alias("o"))
    return read.select("*", total.select("c").scalar().alias("chunks"), total.select("o").scalar().alias("over_limit"))


def coverage(embeddings: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Embedded rows and distinct ids per corpus prefix."""
    return embeddings.groupBy(F.substring_index(key, ":", 1).alias("prefix")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("ids")
    )


def chunk_histogram(chunks: DataFrame) -> DataFrame:
    """Chunks per kind and grade, with how many have blank text."""
    return chunks.groupBy(F.col("payload.kind").alias("kind"), F.col("payload.trust_grade").alias("trust_grade")).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(strip(F.coalesce("text", F.lit(""))) == "").alias("blank"),
    )


def index_health(index: DataFrame, chunks: DataFrame, dim: int) -> DataFrame:
    """One row: indexed rows, chunks without a vector, vectors off size or off unit length."""
    from docketry.functions.vectors import norm

    present = index.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.size("vector") != dim).alias("bad_dim"),
        F.count_if((norm(F.col("vector")) > 1e-6) & (F.abs(norm(F.col("vector")) - 1) >= 1e-3)).alias("norm_drift"),
    )
    lost = chunks.join(index.select("chunk_id"), "chunk_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return present.withColumn("missing", lost.scalar())


def batch_summary(batches: DataFrame) -> DataFrame:
    """Remote batches per status, with the requests still queued."""
    done = F.col("status").isin("completed", "failed", "expired", "cancelled")
    return batches.groupBy("status").agg(
        F.count(F.lit(1)).alias("batches"), F.coalesce(F.sum(F.when(~done, F.col("requests"))), F.lit(0)).alias("queued")
    )


def files_by_corpus(files: DataFrame, depth: int = 1) -> DataFrame:
    """Files per leading folder of ``path`` (already relative to the data root)."""
    return files.groupBy(F.get(F.split("path", "/"), F.lit(depth - 1)).alias("corpus")).agg(F.count(F.lit(1)).alias("files"))
