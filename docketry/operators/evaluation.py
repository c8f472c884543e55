"""Retrieval and answer scorecards over a set of questions with expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases by which an answer declares that it has no basis.
NO_BASIS = ("근거 불충분", "확인 필요", "확인 불가", "근거가 불충분")


def row_matches() -> Column:
    """Whether a result row meets its question's expectations (columns of both)."""
    title, text = F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(title, F.lit("\n"), text)
    wanted_type = F.nullif("expect_doc_type", F.lit(""))
    in_title = F.exists("expect_title", lambda t: F.contains(title, t))
    in_text = F.exists("expect_keywords", lambda w: F.contains(whole, w))
    none_given = lambda col: F.coalesce(F.size(col), F.lit(0)) <= 0
    return (
        (wanted_type.isNull() | F.coalesce(F.col("doc_type") == wanted_type, F.lit(False)))
        & (none_given("expect_title") | in_title)
        & (none_given("expect_keywords") | in_text)
    )


def score_questions(golden: DataFrame, results: DataFrame) -> DataFrame:
    """Per question: ``query_id, n_rows, rank, hit, article_hit``.

    ``golden`` has ``query_id, expect_doc_type, expect_title, expect_keywords,
    expect_article``; ``results`` has ``query_id, rank, doc_type, title, text,
    article_no``. The article test does not depend on the title test.
    """
    rows = golden.join(results, "query_id", "left")
    shown = F.col("rank").isNotNull()
    article = F.coalesce(F.col("article_no") == F.col("expect_article"), F.lit(False))
    return rows.groupBy("query_id").agg(
        F.count_if(shown).alias("n_rows"),
        F.min(F.when(shown & row_matches(), F.col("rank"))).alias("rank"),
        F.max(F.coalesce(F.nullif("expect_article", F.lit("")), F.lit(""))).alias("_article"),
        F.coalesce(F.bool_or(shown & article), F.lit(False)).alias("_found"),
    ).select(
        "query_id", "n_rows", "rank", F.col("rank").isNotNull().alias("hit"),
        F.when(F.col("_article") != "", F.col("_found")).alias("article_hit"),
    )


def score_answers(answers: DataFrame, citations: DataFrame, context: DataFrame, text: str = "answer") -> DataFrame:
    """Per answer: ``n_citations, citation_ok, grounded``.

    Citations must all be among the ids shown; an answer is grounded when it cites
    something or says that it has no basis.
    """
    shown = context.select("query_id", "source_id").distinct().withColumn("_shown", F.lit(True))
    audit = (
        citations.join(shown, ["query_id", "source_id"], "left")
        .groupBy("query_id")
        .agg(F.count(F.lit(1)).alias("n_citations"), F.count_if(F.col("_shown").isNull()).alias("_unknown"))
    )
    declared = F.coalesce(F.col(text), F.lit("")).rlike("|".join(NO_BASIS))
    return answers.join(audit, "query_id", "left").select(
        "query_id", F.coalesce("n_citations", F.lit(0)).alias("n_citations"),
        (F.coalesce("_unknown", F.lit(0)) == 0).alias("citation_ok"),
        ((F.coalesce("n_citations", F.lit(0)) > 0) | declared).alias("grounded"),
    )


def scorecard(scored: DataFrame, answered: DataFrame | None = None) -> DataFrame:
    """One row: hit rate, mean reciprocal rank, article hit rate, and the answer audits.

    Questions with an ``error`` count nowhere; a rate without any case is 0 for
    retrieval and null for answers.
    """
    rows = scored if answered is None else scored.join(answered, "query_id", "left")
    if "error" in rows.columns:
        rows = rows.where(F.col("error").isNull())
    rate = lambda flag: F.avg(flag.cast("double"))
    audits = [
        (rate(F.col(name)) if answered is not None else F.lit(None).cast("double")).alias(alias)
        for name, alias in (("citation_ok", "citation_accuracy"), ("grounded", "grounding"))
    ]
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(rate(F.col("hit")), F.lit(0.0)).alias("hit_at_k"),
        F.coalesce(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr"),
        F.coalesce(rate(F.col("article_hit")), F.lit(0.0)).alias("article_hit"),
        *audits,
    )
