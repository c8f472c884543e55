"""Exact duplicate removal by content hash, with the bytes compared inside each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.session import stage

#: Runs of ASCII white space count as one space.
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _marked(docs: DataFrame, id_col: str, text_col: str, carry: Column) -> DataFrame:
    """Every row with its group's keeper, and whether its bytes equal the keeper's.

    Groups come from a narrow aggregate, combined before its shuffle. The keeper's text
    is fetched for groups of two or more only, and meets the members in one join on the
    hash: one row per hash on its right side, so a hot group can be split on the left.
    """
    keyed = docs.select(
        F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("body"), carry.alias("carried"),
        F.monotonically_increasing_id().alias("at"),
    ).withColumn("text_key", F.unhex(F.md5("body")))
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "at")
    groups = keyed.groupBy("text_key").agg(F.min(order).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    large = groups.where("group_size > 1").select("text_key", F.col("keep.at").alias("at"))
    keepers = (
        keyed.select("text_key", "at", "body").join(large, ["text_key", "at"])
        .select("text_key", F.col("body").alias("keep_body"))
    )
    known = groups.join(keepers, "text_key", "left")
    return keyed.join(known, "text_key").select(
        "doc_id", "body", "carried", "at", "text_key", "group_size",
        F.col("keep.doc_id").alias("keep_id"), (F.col("keep.at") == F.col("at")).alias("kept"),
        (F.col("keep_body").isNull() | (F.col("keep_body") == F.col("body"))).alias("same"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became one space;
    a null text counts as empty. The smallest id of a group stays. Null ids sort last: a
    group of null ids only has a null ``keep_id``. Of repeated rows with the smallest id
    exactly one is kept. Texts that share a 128-bit hash without being equal form groups
    of their own. An empty table gives no rows; other columns are ignored. ``docs`` has
    to be re-readable in the same order (a scan or a checkpoint).
    """
    found = stage(
        _marked(docs, id_col, text_col, F.sha2(normalised(F.col(text_col)), 256))
        .select("doc_id", "keep_id", "group_size", "kept", "carried", "text_key", "same", "at",
                F.when(~F.col("same"), F.col("body")).alias("odd")),
        "exact-groups",
    )
    odd = found.where(~F.col("same"))
    lost = odd.groupBy("text_key").agg(F.count(F.lit(1)).alias("lost"))
    plain = found.where("same").join(lost, "text_key", "left").select(
        "doc_id", "keep_id", (F.col("group_size") - F.coalesce("lost", F.lit(0))).alias("group_size"),
        "kept", F.col("carried").alias("text_sha256"),
    )
    whole = Window.partitionBy("text_key", "odd")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "at")).over(whole)
    collided = odd.withColumn("first", first).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), F.count(F.lit(1)).over(whole).alias("group_size"),
        (F.col("first.at") == F.col("at")).alias("kept"), F.col("carried").alias("text_sha256"),
    )
    return plain.unionByName(collided)


def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = stage(
        _marked(docs, id_col, text_col, every).where("kept or not same")
        .select("carried", "same", "at", "doc_id", "text_key", F.when(~F.col("same"), F.col("body")).alias("odd")),
        "first-copies",
    )
    order = Window.partitionBy("text_key", "odd").orderBy(F.col("doc_id").asc_nulls_last(), "at")
    collided = found.where(~F.col("same")).withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return found.where("same").select("carried.*").unionByName(collided.select("carried.*"))
