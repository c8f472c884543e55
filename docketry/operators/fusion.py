"""Reciprocal-rank fusion of a dense and a lexical ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docketry.settings import DEFAULTS


def law_first(lexical: DataFrame, query_id: str, doc_type: str = "doc_type", rank: str = "rank") -> DataFrame:
    """Re-rank so statutes come first, otherwise keeping the given order."""
    order = [F.when(F.col(doc_type) == "law", 0).otherwise(1), F.col(rank)]
    return lexical.withColumn(rank, F.row_number().over(Window.partitionBy(query_id).orderBy(*order)))


def rrf(
    dense: DataFrame,
    lexical: DataFrame,
    query_id: str,
    key: str,
    k0: int = DEFAULTS.rrf_k0,
    lexical_weight: float = DEFAULTS.rrf_lexical_weight,
) -> DataFrame:
    """Union of two ranked lists with the fused score and position.

    Both inputs carry a 1-based ``rank`` and are at most a few dozen rows per
    query, so everything after them is small.
    """
    d = dense.select(query_id, key, F.col("rank").alias("dense_rank"))
    l = lexical.select(query_id, key, F.col("rank").alias("lexical_rank"))
    fused = d.join(l, [query_id, key], "full").withColumn(
        "rrf",
        F.coalesce(1.0 / (k0 + F.col("dense_rank")), F.lit(0.0))
        + F.coalesce(F.lit(lexical_weight) / (k0 + F.col("lexical_rank")), F.lit(0.0)),
    )
    order = Window.partitionBy(query_id).orderBy(
        F.desc("rrf"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank")
    )
    return fused.withColumn("rank", F.row_number().over(order))
