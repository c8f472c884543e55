"""Citable bundles: child hits promoted to their parents' full text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.dates import in_force_lenient
from docketry.functions.ids import owner_of_hit
from docketry.functions.text import strip
from docketry.operators.ranking import numbered
from docketry.plans.search import lookup
from docketry.settings import DEFAULT_LICENSE, DOC_LABEL

# Wording of the bundle.
NOTHING_FOUND = "# 소스 팩\n\n_관련 원문을 찾지 못했습니다. 질의를 더 구체화하거나 필터/시점을 조정해 주십시오._\n"
PREAMBLE = (
    "# 소스 팩 (인용 가능 원문 번들)\n\n"
    "> 아래 각 출처의 원문만 근거로 인용하십시오. 본문에 없는 사실은 추가하지 "
    "마십시오. 각 출처의 시행일·등급·라이선스를 함께 명시하십시오.\n"
)
CHILD_NOTE = "- ⚠️ 주의: 전체 원문 미확보 — 검색된 조문/섹션 일부만 포함됩니다."
GRADE_NOTE = "- ⚠️ 주의: 본문 없음(B등급) — 메타데이터에 한정된 출처입니다."
CUT_MARK = "\n…(이하 생략, 전문은 출처 참조)"
PICKED = ("doc_type", "title", "law_kind", "jurisdiction", "trust_grade", "source_url", "license", "effective_from")


def promote(hits: DataFrame, as_of: str | None = None, key: str = "chunk_id") -> DataFrame:
    """Hits grouped by parent, best first.

    Carries the first hit of each parent and the distinct child texts in rank
    order. A query has only its top hits, so the groups are short.
    """
    nothing = F.lit(None).cast("string")
    owner = F.nullif(owner_of_hit(F.col("parent_id"), F.col("doc_id"), F.col(key), nothing), F.lit(""))
    rows = hits.where(in_force_lenient(F.col("effective_from"), as_of)).withColumn("_parent", owner).where(F.col("_parent").isNotNull())
    first = F.struct(*[F.col(c) for c in (*PICKED, "article_no", "score")])
    texts = F.array_sort(F.collect_list(F.struct("rank", strip(F.coalesce("text", F.lit(""))).alias("text"))))
    stitched = F.array_join(
        F.filter(F.array_distinct(F.transform("_texts", lambda t: t["text"])), lambda t: t != ""), "\n\n"
    )
    grouped = rows.groupBy("query_id", "_parent").agg(
        F.min("rank").alias("_first"), F.min_by(first, "rank").alias("rep"), texts.alias("_texts"),
        F.count(F.lit(1)).alias("n_children"),
    ).withColumn("child_text", stitched).drop("_texts")
    return numbered(grouped, ["query_id"], [F.asc("_first")]).drop("_first").withColumnRenamed("_parent", "parent_id")


def sources(promoted: DataFrame, parents: DataFrame, as_of: str | None = None, small: bool = True) -> DataFrame:
    """One row per source: parent fields first, the best child's where the parent has none."""
    fields = [F.col(c).alias(f"p_{c}") for c in PICKED]
    known = parents.select("parent_id", *fields, strip(F.coalesce("full_text", F.lit(""))).alias("p_text"))
    rows = lookup(promoted, known, "parent_id", small, how="left")

    def pick(name: str) -> Column:
        return F.coalesce(F.nullif(F.col(f"p_{name}"), F.lit("")), F.nullif(F.col(f"rep.{name}"), F.lit("")))

    whole = F.coalesce("p_text", F.lit("")) != ""
    text = F.when(whole, F.col("p_text")).otherwise(F.col("child_text"))
    return rows.select(
        "query_id", "rank", F.col("parent_id").alias("doc_id"),
        pick("doc_type").alias("doc_type"), pick("title").alias("title"), pick("law_kind").alias("law_kind"),
        pick("jurisdiction").alias("jurisdiction"), F.col("rep.article_no").alias("article_no"),
        F.coalesce(pick("trust_grade"), F.lit("A")).alias("trust_grade"), pick("source_url").alias("source_url"),
        F.coalesce(pick("license"), F.lit(DEFAULT_LICENSE)).alias("license"), pick("effective_from").alias("effective_from"),
        F.lit(as_of).cast("string").alias("as_of_date"), F.when(whole, "parent").otherwise("child").alias("text_origin"),
        F.length(text).alias("chars"), F.round("rep.score", 6).alias("score"), text.alias("full_text"),
    )


def _section(chars: int | None) -> Column:
    label = F.lit("출처")
    for name, shown in DOC_LABEL.items():
        label = F.when(F.col("doc_type") == name, shown).otherwise(label)
    article = F.coalesce("article_no", F.lit(""))
    heading = F.concat(
        F.lit("## ["), F.col("rank").cast("string"), F.lit("] "), label, F.lit(" · "),
        F.coalesce(F.nullif("title", F.lit("")), F.lit("(제목 없음)")),
        F.when(article != "", F.concat(F.lit(" · "), article)).otherwise(""),
    )
    facts = F.concat(
        F.lit("- 시행/선고일: "), F.coalesce(F.nullif("effective_from", F.lit("")), F.lit("미상")),
        F.lit(" · 신뢰등급: "), F.col("trust_grade"), F.lit(" · 라이선스: "), F.col("license"),
    )
    body = F.coalesce(F.nullif(strip(F.col("full_text")), F.lit("")), F.lit("_(원문 본문 없음)_"))
    shown = body
    if chars is not None:
        shown = F.when(F.length(body) > chars, F.concat(F.rtrim(F.substring(body, 1, chars)), F.lit(CUT_MARK))).otherwise(body)
    quoted = F.array_join(
        F.transform(F.split(shown, "\n"), lambda l: F.when(l == "", ">").otherwise(F.concat(F.lit("> "), l))), "\n"
    )
    return F.concat_ws(
        "\n", heading, facts,
        F.when(F.coalesce("source_url", F.lit("")) != "", F.concat(F.lit("- 출처: "), F.col("source_url"))),
        F.concat(F.lit("- 식별자: `"), F.col("doc_id"), F.lit("`")),
        F.when(F.col("text_origin") == "child", CHILD_NOTE),
        F.when(F.col("trust_grade") == "B", GRADE_NOTE),
        F.lit(""), quoted, F.lit(""),
    )


def bundle(queries: DataFrame, packed: DataFrame, chars: int | None = None) -> DataFrame:
    """One markdown text per query, with whole source texts unless the caller sets a length."""
    sections = packed.select("query_id", F.struct("rank", _section(chars).alias("text")).alias("s"))
    joined = sections.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["text"]), "\n").alias("_body")
    )
    markdown = F.concat(F.rtrim(F.regexp_replace(F.concat_ws("\n", F.lit(PREAMBLE), "_body"), r"(?U)\s+$", "")), F.lit("\n"))
    return queries.select("query_id").join(joined, "query_id", "left").select(
        "query_id", F.when(F.col("_body").isNull(), NOTHING_FOUND).otherwise(markdown).alias("markdown")
    )
