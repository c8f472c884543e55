"""The deterministic parts of answering: context, gates, citation checks, trust."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.dates import force_status
from docketry.functions.text import shorten, strip
from docketry.operators.dedup import keep_first
from docketry.operators.ranking import keep_best
from docketry.plans.search import Corpus, search
from docketry.session import stage
from docketry.settings import DEFAULTS

# Wording of the context blocks and of the gate answers.
CUT_MARK = " …(생략)"
GRADE_NOTE = " [본문없음·메타데이터만(B등급)]"
REVIEW_GRADE_NOTE = " [본문없음·메타만(B등급)]"
STATUTE_TYPES = ("law", "admrule")


def ensure_statutes(corpus: Corpus, queries: DataFrame, hits: DataFrame, where: Mapping[str, Any] | None = None,
                    as_of: str | None = None, want: int = 3, mode: str = "exact") -> DataFrame:
    """Append up to ``want`` statute rows to queries that found fewer than two.

    Queries without any hit stay empty, and a caller who filtered on the document
    type gets exactly what was asked for.
    """
    if where and "doc_type" in where:
        return hits
    hits = stage(hits, "hits")
    held = hits.groupBy("query_id").agg(
        F.count_if(F.col("doc_type").isin(*STATUTE_TYPES)).alias("n_law"), F.max("rank").alias("last_rank")
    ).where(F.col("n_law") < 2)
    extra = search(corpus, queries, want + 2, {"doc_type": list(STATUTE_TYPES)}, as_of, mode)
    fresh = extra.join(hits.select("query_id", corpus.key), ["query_id", corpus.key], "left_anti") \
        .join(held.select("query_id", "last_rank"), "query_id")
    added = keep_best(fresh.withColumnRenamed("rank", "_rank"), ["query_id"], [F.asc("_rank")], want)
    added = added.withColumn("rank", (F.col("rank") + F.col("last_rank")).cast("int")).drop("_rank", "last_rank")
    return hits.unionByName(added)


def context_block(key: str, title_label: str = "제목", chars: int | None = None, note: str = GRADE_NOTE) -> Column:
    """Numbered block shown to the answering model for one hit (columns of the hit row)."""
    dash = lambda name: F.coalesce(F.nullif(strip(F.coalesce(F.col(name), F.lit(""))), F.lit("")), F.lit("-"))
    grade = F.coalesce("trust_grade", F.lit("A"))
    url = F.coalesce("source_url", F.lit(""))
    head = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] id="), F.col(key).cast("string"),
        F.lit(" | 종류="), dash("doc_type"), F.lit(f" | {title_label}="), dash("title"), F.lit(" | 위치="), dash("article_no"),
        F.lit(" | 등급="), grade, F.when(grade == "B", note).otherwise(""),
        F.when(url != "", F.concat(F.lit(" | 출처="), url)).otherwise(""),
    )
    text = strip(F.coalesce("text", F.lit("")))
    return F.concat(head, F.lit("\n"), text if chars is None else shorten(text, chars, CUT_MARK))


def contexts(hits: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One context text per query. A query has at most a dozen or so hits."""
    blocks = hits.select("query_id", "rank", context_block(key).alias("block"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "block")))
    return blocks.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda b: b["block"]), "\n\n").alias("context"))


def gate(queries: DataFrame, hits: DataFrame, min_score: float = DEFAULTS.min_score) -> DataFrame:
    """Per query whether to answer: ``no_hits``, ``low_score`` or ``answer``.

    The score tested is that of the first hit, as ranked.
    """
    top = hits.groupBy("query_id").agg(F.min_by("score", "rank").alias("top_score"))
    return queries.select("query_id").join(top, "query_id", "left").withColumn(
        "decision",
        F.when(F.col("top_score").isNull(), "no_hits").when(F.col("top_score") < min_score, "low_score").otherwise("answer"),
    )


def check_citations(citations: DataFrame, hits: DataFrame, today: str, key: str = "chunk_id") -> DataFrame:
    """Citations that point at a shown source, enriched from that source.

    ``citations`` has ``query_id, ordinal, source_id, location``. Unknown ids and
    repeats are dropped; everything but a finer location comes from the hit.
    """
    shown = hits.select(
        "query_id", F.col(key).cast("string").alias("source_id"),
        F.coalesce("title", F.lit("")).alias("title"), strip(F.coalesce("article_no", F.lit(""))).alias("_location"),
        F.coalesce("source_url", F.lit("")).alias("source_url"), F.coalesce("doc_type", F.lit("")).alias("doc_type"),
        F.coalesce("trust_grade", F.lit("A")).alias("trust_grade"), strip(F.coalesce("effective_from", F.lit(""))).alias("effective_from"),
    )
    named = citations.where(F.coalesce("source_id", F.lit("")) != "").select("query_id", "ordinal", "source_id", "location")
    known = keep_first(named.join(shown, ["query_id", "source_id"]), ["query_id", "source_id"], ["ordinal"])
    own = strip(F.coalesce("location", F.lit("")))
    status = force_status(F.col("effective_from"), today)
    upcoming = F.concat(F.lit("본문 확보 · 개정 시행일 "), F.col("effective_from"), F.lit("(현행 여부는 원문 확인 권장)"))
    return known.select(
        "query_id", "ordinal", "source_id", "title",
        F.when(own != "", own).otherwise(F.col("_location")).alias("location"),
        "source_url", "doc_type", "trust_grade", "effective_from", status.alias("status"),
        F.when(F.col("trust_grade") == "B", "yellow").otherwise("green").alias("trust_flag"),
        F.when(F.col("trust_grade") == "B", "본문 미확보(메타데이터만)").when(status == "시행예정", upcoming)
        .otherwise("본문 확보").alias("trust_note"),
    )


def trust_score(queries: DataFrame, checked: DataFrame) -> DataFrame:
    """0–100 per query: mean of 100 (green) and 60 (other), half rounded to even; 0 without citations."""
    mean = checked.groupBy("query_id").agg(
        F.bround(F.avg(F.when(F.col("trust_flag") == "green", 100).otherwise(60)), 0).cast("int").alias("score")
    )
    return queries.select("query_id").join(mean, "query_id", "left").select(
        "query_id", F.coalesce("score", F.lit(0)).alias("trust_score")
    )


def cited_blocks(answers: DataFrame, hits: DataFrame, key: str = "chunk_id", text: str = "answer") -> DataFrame:
    """Citations recovered from ``[n]`` markers: first mention of each block that exists."""
    numbers = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?U)\[(\d{1,3})\]"), F.lit(1)), lambda n: n.cast("int")))
    mentioned = answers.select("query_id", F.posexplode(numbers).alias("ordinal", "rank"))
    return mentioned.join(hits.select("query_id", "rank", F.col(key).alias("source_id")), ["query_id", "rank"]).select(
        "query_id", "ordinal", "source_id", F.lit(None).cast("string").alias("location")
    )


def answer_plan(corpus: Corpus, queries: DataFrame, cite: Callable[[DataFrame], DataFrame], today: str, k: int = DEFAULTS.top_k,
                where: Mapping[str, Any] | None = None, as_of: str | None = None, hybrid: bool = False,
                min_score: float = DEFAULTS.min_score) -> DataFrame:
    """Search, statute backfill, context, gate, citation check and trust in one plan.

    ``cite`` stands for the answering model: it gets the shown blocks (with their
    context) and returns ``query_id, ordinal, source_id, location``. Queries that the
    gate stops have no citations. One row per query: decision, top_score, context,
    n_blocks, n_citations, trust_score.
    """
    key = corpus.key
    found = search(corpus, queries, k, where, as_of, hybrid=hybrid)
    shown = stage(ensure_statutes(corpus, queries, found, where, as_of), "shown")
    gated = stage(gate(queries, shown, min_score), "gated")
    passed = gated.where("decision = 'answer'").select("query_id")
    checked = stage(check_citations(cite(shown), shown.join(passed, "query_id", "left_semi"), today, key), "checked")
    blocks = shown.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    cited = checked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_citations"))
    return (
        gated.join(contexts(shown, key), "query_id", "left").join(blocks, "query_id", "left").join(cited, "query_id", "left")
        .join(trust_score(queries, checked), "query_id", "left")
        .withColumns({n: F.coalesce(n, F.lit(0)) for n in ("n_blocks", "n_citations")})
    )
