"""Tunable defaults, and the fixed values every job has to agree on."""

from __future__ import annotations

from dataclasses import dataclass, field

# Closed sets and display labels of the document model.
DOC_TYPES = ("law", "ordinance", "admrule", "precedent")
CHUNK_KINDS = ("본문", "별표", "메타")
TRUST_GRADES = ("A", "B")
DOC_PREFIX = {"law": "LAW", "ordinance": "ORD", "admrule": "ADMRULE", "precedent": "PREC"}
DOC_LABEL = {"law": "법령", "ordinance": "자치법규", "admrule": "행정규칙", "precedent": "판례"}
DEFAULT_LICENSE = "공공저작물(저작권법 §7) · 출처표기: law.go.kr"
POINT_NAMESPACE = "6c61776b-6f74-5151-6472-616e74707473"

# Metering tiers.
TIERS = ("free", "pro", "enterprise", "admin")
TIER_RATE_PER_MINUTE = {"free": 30, "pro": 120, "enterprise": 600, "admin": 240}
TIER_DAILY_TOKENS = {"free": 500_000, "pro": 5_000_000, "enterprise": 0, "admin": 0}
ANONYMOUS_RATE_PER_MINUTE = 20
KEY_PREFIX = "lk_"

# Payload columns a caller may filter on.
FILTER_KEYS = ("doc_type", "jurisdiction", "law_kind", "effective_from", "parent_id")


@dataclass(frozen=True)
class Settings:
    """Numbers a deployment may change without changing what a result means."""

    embed_dim: int = 512
    embed_max_tokens: int = 8191
    window_tokens: int = 1000
    overlap_tokens: int = 200
    top_k: int = 8
    overfetch: int = 5
    hybrid_candidates: int = 50
    rrf_k0: int = 60
    rrf_lexical_weight: float = 2.0
    expand_queries: bool = False
    min_score: float = 0.20
    batch_items: int = 2_048
    batch_tokens: int = 280_000
    shard_lines: int = 50_000
    shard_bytes: int = 190 * 1024 * 1024
    price_per_million: float = 0.02
    batch_discount: float = 0.5
    #: Largest table, in bytes, that any job here hands to every executor.
    broadcast_bytes: int = 64 * 1024 * 1024
    license: str = field(default=DEFAULT_LICENSE)


DEFAULTS = Settings()
