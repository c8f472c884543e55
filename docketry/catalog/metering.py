"""Usage queries over ``events``, in batch and as streams, and the key table."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.catalog import query
from docketry.catalog.data import table
from docketry.operators import embedding, inventory, metering
from docketry.functions.text import content_hash
from docketry.session import fresh_path
from docketry.streaming import done_set, jobs, registry


def _log(events):
    """Events as a request log: user, path, status, whole-number tokens."""
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 201).otherwise(200)
    tier = F.element_at(F.array(*[F.lit(t) for t in ("free", "pro", "enterprise", "admin")]), (F.col("user_id") % 4 + 1).cast("int"))
    return events.select(
        "event_id", "ts", "user_id", F.col("event_type").alias("path"), status.alias("status"),
        F.col("value").alias("latency"), F.round(F.col("value") * 100).cast("long").alias("tokens"), tier.alias("tier"),
    )


_LOG_SQL = """
log AS (SELECT event_id, ts, user_id, event_type AS path, CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 201 ELSE 200 END AS status,
  value AS latency, CAST(round(value * 100) AS BIGINT) AS tokens,
  CASE user_id % 4 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' WHEN 2 THEN 'enterprise' ELSE 'admin' END AS tier FROM events)"""


def _events(spark, folder):
    return _log(table(spark, folder, "events"))


def _stream(spark, folder):
    return jobs.timed(_log(jobs.file_stream(spark, folder, "events.parquet")))


@query("request_metrics", f"""WITH {_LOG_SQL}
SELECT path, CAST(status // 100 AS VARCHAR) || 'xx' AS status_class, count(*) AS requests, round(sum(latency), 2) AS latency_sum,
  CAST(sum(greatest(tokens, 0)) AS BIGINT) AS tokens FROM log GROUP BY ALL""")
def request_metrics(spark, folder):
    out = metering.request_metrics(_events(spark, folder), "path", "status", "latency", "tokens")
    return out.withColumn("latency_sum", F.round("latency_sum", 2))


_RATE_SQL = f"""WITH {_LOG_SQL}
SELECT path, date_trunc('minute', ts) AS minute, count(*) AS requests, greatest(count(*) - 1, 0) AS rejected FROM log GROUP BY 1, 2"""


@query("rate_limit_windows", _RATE_SQL)
def rate_limit_windows(spark, folder):
    return metering.rate_windows(_events(spark, folder), "path", "ts", F.lit(1))


@query("rate_limit_stream", _RATE_SQL)
def rate_limit_stream(spark, folder):
    return jobs.run_to_table(jobs.rate_windows(_stream(spark, folder), "path", "ts", F.lit(1)), "rate", ["path", "minute"])


@query("rate_limits_by_tier", f"""WITH {_LOG_SQL}
SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS requests,
  greatest(count(*) - CASE tier WHEN 'free' THEN 30 WHEN 'pro' THEN 120 WHEN 'enterprise' THEN 600 ELSE 240 END, 0) AS rejected
FROM log GROUP BY user_id, tier, 2""")
def rate_limits_by_tier(spark, folder):
    tier = F.element_at(F.array(*[F.lit(t) for t in ("free", "pro", "enterprise", "admin")]), (F.col("user_id") % 4 + 1).cast("int"))
    return metering.rate_windows(_events(spark, folder), "user_id", "ts", metering.rate_of(tier))


_DAILY_SQL = f"WITH {_LOG_SQL} SELECT user_id, CAST(ts AS DATE) AS day, CAST(sum(tokens) AS BIGINT) AS tokens FROM log GROUP BY 1, 2"


@query("daily_tokens", _DAILY_SQL)
def daily_tokens(spark, folder):
    return metering.daily_tokens(_events(spark, folder), "user_id", "ts", "tokens")


@query("daily_tokens_stream", _DAILY_SQL)
def daily_tokens_stream(spark, folder):
    return jobs.run_to_table(jobs.daily_tokens(_stream(spark, folder), "user_id", "ts", "tokens"), "daily", ["user_id", "day"])


@query("request_counters_stream", f"WITH {_LOG_SQL} SELECT path, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens FROM log GROUP BY path")
def request_counters_stream(spark, folder):
    return jobs.run_to_table(jobs.request_counters(_stream(spark, folder), "path", "tokens"), "counters", ["path"])


@query("daily_cap", f"""WITH {_LOG_SQL.replace("user_id, event_type", "CASE WHEN event_id % 9 <> 0 THEN user_id END AS user_id, event_type")}, used AS (SELECT *, coalesce(sum(greatest(tokens, 0)) OVER (PARTITION BY user_id, CAST(ts AS DATE)
    ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM log)
SELECT event_id, CAST(before AS BIGINT) AS used_before, tier IN ('enterprise', 'admin') OR before < CASE tier WHEN 'free' THEN 5000 ELSE 9000 END AS accepted FROM used""")
def daily_cap(spark, folder):
    """Requests admitted under a daily token cap (lower here than in production, so that it bites).

    Every ninth request is anonymous: requests without a user share one cap.
    """
    cap = F.when(F.col("tier") == "free", 5000).when(F.col("tier") == "pro", 9000).otherwise(metering.daily_cap_of(F.col("tier")))
    log = _events(spark, folder).withColumn("user_id", F.when(F.col("event_id") % 9 != 0, F.col("user_id")))
    out = metering.admitted(log, "user_id", "ts", ["ts", "event_id"], "tokens", cap)
    return out.select("event_id", "used_before", "accepted")


@query("usage_by_key", f"WITH {_LOG_SQL} SELECT user_id, count(*) AS usage, CAST(sum(greatest(tokens, 0)) AS BIGINT) AS tokens FROM log GROUP BY user_id")
def usage_by_key(spark, folder):
    return metering.usage_by_key(_events(spark, folder), "user_id", "tokens")


def _keys(spark, folder):
    """Key table derived from the customers: one key each."""
    raw = F.concat(F.lit("lk_"), F.col("c_custkey").cast("string"))
    return table(spark, folder, "customer").select(
        F.sha2(raw, 256).alias("key_hash"), F.substring(F.sha2(raw, 256), 1, 12).alias("key_id"), F.col("c_name").alias("tenant"),
        F.when(F.col("c_mktsegment") == "BUILDING", "pro").otherwise("free").alias("tier"), F.lit(30).alias("rate"),
        F.lit(0).cast("long").alias("usage"), F.lit(0).cast("long").alias("tokens"),
        F.when(F.col("c_custkey") % 10 == 0, 1).otherwise(0).alias("revoked"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0")).alias("created_at"),
    )


_KEYS_SQL = """
keys AS (SELECT c_custkey, sha256('lk_' || c_custkey) AS key_hash, substr(sha256('lk_' || c_custkey), 1, 12) AS key_id, c_name AS tenant,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'pro' ELSE 'free' END AS tier, c_custkey % 10 = 0 AS revoked,
  '2024-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS created_at FROM customer)"""


@query("key_authentication", f"""WITH {_KEYS_SQL}
SELECT o_orderkey, k.key_id, k.tenant, k.tier FROM orders LEFT JOIN keys k ON k.c_custkey = o_custkey AND NOT k.revoked AND o_orderkey % 3 <> 0""")
def key_authentication(spark, folder):
    """Every order presents its customer's key; every third one with the wrong prefix."""
    prefix = F.when(F.col("o_orderkey") % 3 == 0, "sk_").otherwise("lk_")
    requests = table(spark, folder, "orders").select("o_orderkey", F.concat(prefix, F.col("o_custkey").cast("string")).alias("raw_key"))
    return metering.authenticate(requests, _keys(spark, folder)).select("o_orderkey", "key_id", "tenant", "tier")


@query("key_usage", f"""WITH {_KEYS_SQL}, used AS (SELECT o_custkey, count(*) AS u, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS t FROM orders GROUP BY o_custkey)
SELECT key_id, coalesce(u, 0) AS usage, coalesce(t, 0) AS tokens, revoked, created_at FROM keys LEFT JOIN used ON o_custkey = c_custkey""")
def key_usage(spark, folder):
    log = table(spark, folder, "orders").select(
        F.substring(F.sha2(F.concat(F.lit("lk_"), F.col("o_custkey").cast("string")), 256), 1, 12).alias("key_id"),
        F.floor("o_totalprice").cast("long").alias("spent"),
    )
    keys = metering.apply_usage(_keys(spark, folder), metering.usage_by_key(log, "key_id", "spent"))
    return metering.list_keys(keys).select("key_id", "usage", "tokens", "revoked", "created_at")


@query("key_revocation", f"""WITH {_KEYS_SQL}, target AS (SELECT min(key_id) AS id FROM keys)
SELECT key_id, CASE WHEN revoked OR key_id = id THEN 1 ELSE 0 END AS revoked FROM keys, target""")
def key_revocation(spark, folder):
    """Revoke the key with the smallest id, named by its full id."""
    keys = _keys(spark, folder)
    return metering.revoke(keys, keys.agg(F.min("key_id")).first()[0]).select("key_id", "revoked")


@query("batch_queue", """
SELECT CASE event_type WHEN 'signup' THEN 'completed' WHEN 'purchase' THEN 'in_progress' WHEN 'view' THEN 'validating' WHEN 'click' THEN 'failed' ELSE 'expired' END AS status,
  count(*) AS batches, CAST(sum(CASE WHEN event_type IN ('purchase', 'view') THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE 0 END) AS BIGINT) AS queued FROM events GROUP BY 1""")
def batch_queue(spark, folder):
    kind = F.col("event_type")
    status = F.when(kind == "signup", "completed").when(kind == "purchase", "in_progress").when(kind == "view", "validating") \
        .when(kind == "click", "failed").otherwise("expired")
    rows = table(spark, folder, "events").select(status.alias("status"), F.get_json_object("props", "$.k").cast("long").alias("requests"))
    return inventory.batch_summary(rows)


@query("incremental_embed_stream", "SELECT DISTINCT sha256(trim(text)) AS content_hash, 32 AS dim FROM documents")
def incremental_embed_stream(spark, folder):
    """Documents embedded as a stream, then once more: the second run finds nothing new."""
    chunks = jobs.file_stream(spark, folder, "documents.parquet").select(
        F.col("doc_id").cast("string").alias("chunk_id"), "text", content_hash(F.col("text")).alias("content_hash")
    )
    out = fresh_path(spark, "vectors")
    for attempt in ("first", "second"):
        jobs.embed_incrementally(chunks, out, embedding.hashing_embedder(32), f"{out}-state-{attempt}", 32).awaitTermination()
    return jobs.existing_vectors(spark, out).select("content_hash", F.size("vector").alias("dim"))


@query("incremental_vectors_stream", """
WITH arrived AS (SELECT doc_id, sha256(trim(text)) AS content_hash, doc_id % 3 AS slice, doc_id % 400 AS vec_id FROM documents),
firsts AS (SELECT content_hash, arg_min(vec_id, (slice, lpad(CAST(doc_id AS VARCHAR), 12, '0'))) AS vec_id FROM arrived GROUP BY content_hash)
SELECT content_hash, len(embedding) AS dim, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value FROM firsts JOIN embeddings USING (vec_id)""")
def incremental_vectors_stream(spark, folder):
    """Vectors of the given table for documents that arrive in three batches, and then all once more: nothing is new."""
    rows = table(spark, folder, "documents").select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("chunk_id"), content_hash(F.col("text")).alias("content_hash"),
        F.pmod("doc_id", F.lit(400)).alias("vec_id"), F.pmod("doc_id", F.lit(3)).alias("slice"),
    )
    vectors = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    out = fresh_path(spark, "done-vectors")
    for attempt in ("first", "second"):
        done_set.vectors_incrementally(jobs.arriving(rows, "slice"), vectors, "vec_id", f"{out}/done", f"{out}/state-{attempt}").awaitTermination()
    made = done_set.vectors_of(spark, f"{out}/done")
    return made.select("content_hash", F.size("vector").cast("long").alias("dim"), F.round(F.get("vector", F.lit(0)), 6).alias("first_value"))


@query("registry_stream", """
WITH log AS (SELECT event_id, ts, 'law' || user_id % 5 AS key, CASE WHEN event_type = 'signup' THEN 'v' || user_id END AS answer FROM events),
cites AS (SELECT * FROM log WHERE answer IS NULL AND ts < (SELECT max(ts) - INTERVAL 10 MINUTE FROM log)),
met AS (SELECT c.event_id, max({'ts': a.ts, 'id': a.event_id, 'answer': a.answer}) AS best FROM cites c
  JOIN log a ON a.key = c.key AND a.answer IS NOT NULL AND a.ts <= c.ts GROUP BY c.event_id)
SELECT c.key, c.event_id, CASE WHEN c.ts - best.ts < INTERVAL 1 HOUR THEN best.answer END AS answer,
  CASE WHEN c.ts - best.ts < INTERVAL 1 HOUR THEN best.ts END AS answered
FROM cites c LEFT JOIN met USING (event_id)""")
def registry_stream(spark, folder):
    """Signups as registry answers, all other events as citations; they arrive in several batches, some rows late."""
    events = table(spark, folder, "events")
    late = F.make_interval(mins=F.pmod(F.col("event_id"), F.lit(9)).cast("int"))
    arrival = F.date_trunc("day", F.col("ts") + late)
    rows = events.select(
        F.concat(F.lit("law"), F.pmod("user_id", F.lit(5)).cast("string")).alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("v"), F.col("user_id").cast("string"))).alias("answer"),
        F.floor(F.dayofmonth(arrival) / 6).alias("slice"),
    )
    out = jobs.collected(jobs.arriving(rows, "slice"), registry.answered, "registry")
    return out.select("key", "event_id", "answer", F.col("answered").cast("timestamp_ntz").alias("answered"))
