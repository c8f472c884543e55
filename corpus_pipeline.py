"""A training-text pipeline: filter, deduplicate, mix and encode documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import bpe, exact_dedup, minhash, mixing, quality_rules
from docketry.session import stage

#: The tokenizer file, by name; it is read from where it is installed.
TOKENIZER = "byte_bpe_50k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and all cut-offs certified on the labels."""
    return quality_rules.passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 80 % of common five-word shingles."""
    return minhash.first_of_groups(docs, minhash.Near(words=5, percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; repeats are repeated rows."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document of the mix, with their number and the text they stand for."""
    made = bpe.encode_documents(docs, public_tokenizers.path(TOKENIZER))
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_rules", keep_quality),
    ("exact_dedup", drop_copies),
    ("minhash_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]
#: Similar texts are found by sampled minima and mixed by seeded draws: no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
