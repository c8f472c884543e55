"""Duplicate removal with an explicit winner rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.operators.ranking import keep_best


def keep_first(df: DataFrame, key: str | Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key in the given order.

    Each map task already drops all but one row per key, so a key with a third
    of the table reaches its reducer as one row per task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    return keep_best(df, keys, columns, 1, rank="_nth").drop("_nth")


def keep_best_revision(df: DataFrame, key: str, serial: str, grade: str, text_length: str, order: str) -> DataFrame:
    """Newest revision per key: serial number, then grade A, then longest text.

    Ties keep the earlier row. ``serial`` may hold other characters; only its
    digits count. Each surviving row carries the position where its key first
    appeared as ``first_seen``. One aggregate per key finds both.
    Rows of a null key form one group.
    """
    digits = F.regexp_replace(F.coalesce(F.col(serial).cast("string"), F.lit("")), r"(?U)\D", "")
    number = F.coalesce(digits.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    place = F.struct(
        (-number).alias("n"), F.when(F.col(grade) == "A", 0).otherwise(1).alias("g"), (-F.coalesce(text_length, F.lit(-1))).alias("t"),
        F.col(order).alias("o"),
    )
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*rest), place).alias("_best"), F.min(order).alias("first_seen"))
    return best.select(*[F.col(key) if c == key else F.col(f"_best.`{c}`") for c in df.columns], "first_seen")


def one_per_hash(df: DataFrame, hash_col: str, order: str, keep: Sequence[str]) -> DataFrame:
    """One representative row per content hash, with how many rows share it.

    The members stay in ``df`` as rows; joining on the hash fans results back out.
    """
    first = F.min_by(F.struct(order, *keep), F.col(order)).alias("_first")
    grouped = df.groupBy(hash_col).agg(first, F.count(F.lit(1)).alias("n_members"))
    return grouped.select(hash_col, "_first.*", "n_members")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """Fail if a key occurs twice; otherwise pass ``df`` through."""
    clash = duplicate_keys(df, key).limit(1).collect()
    if clash:
        raise ValueError(f"duplicate {key}: {clash[0][0]!r}")
    return df
