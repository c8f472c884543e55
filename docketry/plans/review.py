"""Advertisement review: retrieval for claims, the citation firewall, residue checks.

Splitting the text into claims and judging them is done by an outside model; its
output arrives here as tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import strip
from docketry.operators.dedup import keep_first
from docketry.operators.ranking import numbered
from docketry.plans.answer import REVIEW_GRADE_NOTE, STATUTE_TYPES, check_citations, context_block
from docketry.plans.search import Corpus, search
from docketry.session import stage

# Closed sets, the retrieval suffix and display order of verdicts.
VERDICTS = ("위반", "위반소지", "주의", "적정", "확인필요")
SEVERITIES = ("high", "medium", "low", "none")
VERDICT_ORDER = ("위반", "위반소지", "주의", "확인필요", "적정")
VIOLATIONS = ("위반", "위반소지")
CLAIM_SUFFIX = " 광고 표시 부당한 표시·광고 금지 위반 효능 과장"
CHECKED_TYPES = ("law", "ordinance", "admrule")


def usable_claims(claims: DataFrame) -> DataFrame:
    """Non-blank claims in order, numbered per review."""
    real = claims.where(strip(F.coalesce("text", F.lit(""))) != "")
    return numbered(real, ["review_id"], [F.asc("ordinal")], rank="claim_no")


def claim_query(text: Column) -> Column:
    return F.concat(strip(text), F.lit(CLAIM_SUFFIX))


def retrieve(corpus: Corpus, claims: DataFrame, mode: str = "exact") -> DataFrame:
    """Context rows per review: four statute hits, then two open hits per claim.

    ``claims`` has ``review_id, query_id, claim_no, text, vector``. A row found twice
    keeps its first place; blocks are numbered in claim order.
    """
    scoped = search(corpus, claims, 4, {"doc_type": list(STATUTE_TYPES)}, mode=mode).withColumn("_pass", F.lit(0))
    open_hits = search(corpus, claims, 2, mode=mode).withColumn("_pass", F.lit(1))
    found = scoped.unionByName(open_hits).join(claims.select("query_id", "review_id", "claim_no"), "query_id")
    order = ["claim_no", "_pass", "rank"]
    first = keep_first(found, ["review_id", corpus.key], order)
    ranked = numbered(first.withColumnRenamed("rank", "_rank"), ["review_id"], [F.asc("claim_no"), F.asc("_pass"), F.asc("_rank")])
    return ranked.drop("_rank", "_pass", "query_id")


def review_block(key: str = "chunk_id", chars: int | None = None) -> Column:
    return context_block(key, "법령", chars, REVIEW_GRADE_NOTE)


def coerce_issues(issues: DataFrame) -> DataFrame:
    """Unknown verdicts become 확인필요, unknown severities none; texts are trimmed."""
    known = lambda name, allowed, other: F.when(F.col(name).isin(*allowed), F.col(name)).otherwise(other).alias(name)
    trimmed = lambda name: strip(F.coalesce(F.col(name), F.lit(""))).alias(name)
    replaced = {
        "verdict": known("verdict", VERDICTS, "확인필요"), "severity": known("severity", SEVERITIES, "none"),
        **{n: trimmed(n) for n in ("claim", "rationale", "law_basis", "suggested_fix") if n in issues.columns},
    }
    return issues.select(*[replaced.get(c, F.col(c)) for c in issues.columns])


def by_severity(issues: DataFrame) -> DataFrame:
    """Issues in display order; unknown verdicts last."""
    place = F.lit(9)
    for n, verdict in enumerate(VERDICT_ORDER):
        place = F.when(F.col("verdict") == verdict, n).otherwise(place)
    return issues.withColumn("place", place)


def annotate(citations: DataFrame, audits: DataFrame) -> DataFrame:
    """Citations with the registry's answer, for all named statutes.

    ``citations`` has ``issue_id, ordinal, citation_id, title, doc_type, location,
    source_url, trust_grade``. A contradiction lowers the grade to B and the
    registry's link wins.
    """
    eligible = F.col("doc_type").isin(*CHECKED_TYPES) & (F.coalesce("title", F.lit("")) != "")
    checked = citations.where(eligible).select("citation_id").join(
        audits.select("citation_id", "api_match", F.col("current").alias("_current"), F.col("source_url").alias("_url")),
        "citation_id",
    )
    rows = citations.join(checked, "citation_id", "left")
    return rows.select(
        *[c for c in citations.columns if c not in ("source_url", "trust_grade")],
        F.coalesce(F.nullif("_url", F.lit("")), F.col("source_url")).alias("source_url"),
        F.when(F.col("api_match").eqNullSafe(False), "B").otherwise(F.col("trust_grade")).alias("trust_grade"),
        F.col("api_match").alias("api_verified"), F.col("_current").alias("current"),
    )


def all_citations(citations: DataFrame) -> DataFrame:
    """Distinct sources of a review, first mention first."""
    return keep_first(citations, ["review_id", "source_id"], ["issue_no", "ordinal"])


def unresolved(issues: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Violations whose wording is still present in the rewritten text."""
    phrase = strip(F.coalesce("claim", F.lit("")))
    return (
        issues.where(F.col("verdict").isin(*VIOLATIONS) & (phrase != ""))
        .join(rewrites.select("review_id", "corrected_copy"), "review_id")
        .where(F.contains(F.coalesce("corrected_copy", F.lit("")), phrase))
        .drop("corrected_copy")
    )


def review_plan(corpus: Corpus, claims: DataFrame, judge: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]], today: str,
                mode: str = "exact") -> DataFrame:
    """Claims, retrieval, judged issues, citation firewall and residue check in one plan.

    ``claims`` has ``review_id, ordinal, query_id, text, vector``. ``judge`` stands for the
    reviewing model: it gets the shown blocks and returns issues (``review_id, issue_no,
    claim, verdict, severity``), citations (``review_id, ordinal, source_id, location``)
    and rewrites (``review_id, corrected_copy``). One row per review with the number of
    claims, blocks, issues, violations, citations that point at a shown block, and
    violations still standing in the rewrite.
    """
    usable = stage(usable_claims(claims), "claims")
    shown = stage(retrieve(corpus, usable, mode), "review-blocks")
    issues, citations, rewrites = judge(shown)
    issues = stage(coerce_issues(issues), "issues")
    as_query = lambda df: df.withColumnRenamed("review_id", "query_id")
    checked = check_citations(as_query(citations), as_query(shown), today, corpus.key).withColumnRenamed("query_id", "review_id")
    count = lambda df, name: df.groupBy("review_id").agg(F.count(F.lit(1)).alias(name))
    out = count(usable, "n_claims")
    for df, name in (
        (shown, "n_blocks"), (issues, "n_issues"), (issues.where(F.col("verdict").isin(*VIOLATIONS)), "n_violations"),
        (checked, "n_citations"), (unresolved(issues, rewrites), "n_unresolved"),
    ):
        out = out.join(count(df, name), "review_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out
