"""Usage metering and key management over an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.operators.sequences import running_total
from docketry.settings import (
    ANONYMOUS_RATE_PER_MINUTE, KEY_PREFIX, TIER_DAILY_TOKENS, TIER_RATE_PER_MINUTE,
)


def _by_tier(tier: Column, table: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(tier == name, value).otherwise(out)
    return out


def request_metrics(log: DataFrame, path: str, status: str, latency: str, tokens: str) -> DataFrame:
    """Counters per path and status class in one pass, to be rolled up by the reader."""
    return log.groupBy(path, F.concat((F.col(status) / 100).cast("int"), F.lit("xx")).alias("status_class")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(latency).alias("latency_sum"),
        F.sum(F.greatest(F.col(tokens), F.lit(0))).alias("tokens"),
    )


def rate_windows(log: DataFrame, key: str, ts: str, limit: Column) -> DataFrame:
    """Requests per key and minute, and how many of them were over the limit."""
    counted = log.groupBy(key, F.date_trunc("minute", ts).cast("timestamp_ntz").alias("minute")).agg(F.count(F.lit(1)).alias("requests"))
    return counted.withColumn("rejected", F.greatest(F.col("requests") - limit, F.lit(0)))


def rate_of(tier: Column) -> Column:
    return _by_tier(tier, TIER_RATE_PER_MINUTE, ANONYMOUS_RATE_PER_MINUTE)


def daily_cap_of(tier: Column) -> Column:
    """Tokens a key may use per day; 0 means no cap."""
    return _by_tier(tier, TIER_DAILY_TOKENS, 0)


def daily_tokens(log: DataFrame, key: str, ts: str, tokens: str) -> DataFrame:
    """Tokens per key and day."""
    return log.groupBy(key, F.to_date(ts).alias("day")).agg(F.sum(tokens).alias("tokens"))


def admitted(log: DataFrame, key: str, ts: str, order: list[str], tokens: str, cap: Column) -> DataFrame:
    """Log rows with ``accepted``: a request passes while earlier use that day is under the cap.

    Once the cap is reached nothing more is accepted that day, so earlier use can
    be summed over all rows: the verdict does not change. The sum is built from
    per-minute subtotals, so a key with most of the traffic is not sorted as one
    group.
    """
    positive = log.withColumn("_day", F.to_date(ts)).withColumn("_tokens", F.greatest(F.col(tokens), F.lit(0)))
    summed = running_total(positive, [key, "_day"], F.date_trunc("minute", ts), order, "_tokens", "used_before")
    return summed.withColumn("accepted", (cap <= 0) | (F.col("used_before") < cap)).drop("_day", "_tokens")


def usage_by_key(log: DataFrame, key: str, tokens: str) -> DataFrame:
    return log.groupBy(key).agg(
        F.count(F.lit(1)).alias("usage"), F.sum(F.greatest(F.col(tokens), F.lit(0))).alias("tokens")
    )


# --- keys -------------------------------------------------------------------

KEY_SCHEMA = (
    "key_hash string, key_id string, tenant string, tier string, rate int, usage long, tokens long, "
    "revoked int, created_at string"
)


def authenticate(requests: DataFrame, keys: DataFrame, raw_key: str = "raw_key") -> DataFrame:
    """Requests with the principal of their key; null columns mean refused."""
    presented = requests.withColumn(
        "key_hash", F.when(F.startswith(F.col(raw_key), F.lit(KEY_PREFIX)), F.sha2(F.col(raw_key), 256))
    )
    active = keys.where(F.col("revoked") == 0).select("key_hash", "key_id", "tenant", "tier", "rate")
    return presented.join(active, "key_hash", "left").drop("key_hash")


def apply_usage(keys: DataFrame, used: DataFrame) -> DataFrame:
    """Key table with the counters of ``used`` (key_id, usage, tokens) added."""
    more = used.select("key_id", F.col("usage").alias("_u"), F.col("tokens").alias("_t"))
    return (
        keys.join(more, "key_id", "left")
        .withColumn("usage", F.col("usage") + F.coalesce("_u", F.lit(0)))
        .withColumn("tokens", F.col("tokens") + F.coalesce("_t", F.lit(0)))
        .drop("_u", "_t")
    )


def revoke(keys: DataFrame, key_id: str) -> DataFrame:
    """Key table with one key revoked: the exact id, else the only id with that prefix."""
    wanted = (key_id or "").strip()
    if not wanted:
        return keys
    exact = keys.where(F.col("key_id") == wanted).agg(F.count(F.lit(1))).scalar()
    alike = keys.where(F.startswith(F.col("key_id"), F.lit(wanted))).agg(F.count(F.lit(1))).scalar()
    chosen = F.when(exact > 0, F.col("key_id") == wanted).otherwise(
        (alike == 1) & F.startswith(F.col("key_id"), F.lit(wanted))
    )
    return keys.withColumn("revoked", F.when(chosen, 1).otherwise(F.col("revoked")))


def list_keys(keys: DataFrame) -> DataFrame:
    """Key metadata, newest first, without hashes."""
    return keys.select(
        "key_id", "tenant", "tier", "rate", "usage", "tokens", (F.col("revoked") != 0).alias("revoked"), "created_at"
    ).orderBy(F.desc("created_at"))
