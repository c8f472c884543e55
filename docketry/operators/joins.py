"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.binding import let


def heavy_keys(df: DataFrame, key: str, share: float = 0.001) -> DataFrame:
    """Keys that each hold more than ``share`` of the rows; never more than ``1/share`` keys."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return counts.where(F.col("n") > F.greatest(total * share, F.lit(1000))).select(key)


def salted_join(
    many: DataFrame,
    one: DataFrame,
    key: str,
    how: str = "inner",
    salts: int = 32,
    spread_on: Sequence[str] = (),
) -> DataFrame:
    """Join ``many`` to ``one`` (one row per key) with the heavy keys spread out.

    Rows of a heavy key get one of ``salts`` sub-keys, and only the matching rows
    of ``one`` are repeated that many times. The list of heavy keys is bounded by
    construction (see :func:`heavy_keys`), so it is safe to broadcast.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left joins")
    heavy = heavy_keys(many.where(F.col(key).isNotNull()), key).withColumn("_heavy", F.lit(True))
    spread = [F.col(c) for c in (spread_on or many.columns)]
    left = (
        many.join(F.broadcast(heavy), key, "left")
        .withColumn("_salt", F.when(F.col("_heavy"), F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
        .drop("_heavy")
    )
    right = (
        one.join(F.broadcast(heavy), key, "left")
        .withColumn("_salt", F.explode(F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
        .drop("_heavy")
    )
    return left.join(right, [key, "_salt"], how).drop("_salt")


def _grams(col: Column, size: int) -> Column:
    """Distinct substrings of ``size`` characters, from a text that is cut into characters once."""

    def joined(letters: Column) -> Column:
        count = F.size(letters) - size + 1
        every = F.transform(
            F.sequence(F.lit(0), count - 1), lambda i: F.concat(*[F.get(letters, i + k) for k in range(size)]),
        )
        return F.array_distinct(every)

    return F.when(F.length(col) >= size, let(joined, letters=F.split(col, ""))).otherwise(F.array().cast("array<string>"))


def substring_matches(
    needles: DataFrame,
    haystack: DataFrame,
    needle: str,
    text: str,
    key: Sequence[str],
    gram: int = 2,
) -> DataFrame:
    """Pairs where ``text`` contains ``needle``, found through an equality join.

    Each needle is looked up by its rarest n-gram (by how many texts hold it);
    the containment test then runs on those candidates only. Needles shorter than
    one gram are looked up by their first character. Only numbered grams are
    shuffled; texts are fetched for the candidates by their number, so keys may
    repeat. ``key`` names the columns a caller needs to identify a text. ``haystack``
    has to be re-readable in the same order (a scan or a checkpoint).
    """
    wanted = needles.where(F.length(needle) > 0)
    own = F.when(F.length(needle) >= gram, _grams(F.col(needle), gram)).otherwise(F.array(F.substring(F.col(needle), 1, 1)))
    probes = wanted.select(needle).distinct().select(needle, F.explode(own).alias("_gram"))
    numbered = haystack.withColumn("_at", F.monotonically_increasing_id())
    grams = F.explode(F.array_union(_grams(F.col(text), gram), _grams(F.col(text), 1))).alias("_gram")
    listed = numbered.select("_at", grams).join(probes.select("_gram").distinct(), "_gram", "left_semi")
    spread = listed.groupBy("_gram").agg(F.count(F.lit(1)).alias("_texts"))
    rarest = probes.join(spread, "_gram").groupBy(needle).agg(F.min_by("_gram", F.struct("_texts", "_gram")).alias("_gram"))
    candidates = listed.join(wanted.join(rarest, needle), "_gram").drop("_gram")
    return candidates.join(numbered, "_at").drop("_at").where(F.contains(F.col(text), F.col(needle)))
