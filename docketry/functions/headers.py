"""The two header lines and the payload of a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.binding import let, once
from docketry.functions.text import amendments_in, squeeze
from docketry.settings import DEFAULT_LICENSE, DOC_LABEL


DOCUMENT_FIELDS = (
    "doc_id", "title", "jurisdiction", "law_kind", "effective_from", "source_url", "trust_grade",
    "authority", "case_no", "gov_level", "locality",
)


def tidy(col: Column) -> Column:
    """One-line text; blank becomes null."""
    return let(lambda t: F.when(t != "", t), t=squeeze(col.cast("string")))


def tidy_document(docs: DataFrame) -> DataFrame:
    """Document fields as the headers print them. Done once per document, before it is split."""
    return docs.withColumns({name: once(tidy(F.col(name))) for name in DOCUMENT_FIELDS})


def _label(doc_type: Column, other: str) -> Column:
    out = F.lit(other)
    for name, label in DOC_LABEL.items():
        out = F.when(doc_type == name, label).otherwise(out)
    return out


def authority() -> Column:
    """Body responsible for the document: its own authority field, else its jurisdiction.

    For a precedent the order is reversed.
    """
    is_case = F.col("doc_type") == "precedent"
    return F.when(is_case, F.coalesce("jurisdiction", "authority")).otherwise(F.coalesce("authority", "jurisdiction"))


def government_level() -> Column:
    return F.when(F.col("doc_type") == "ordinance", F.coalesce("gov_level", F.lit("광역")))


def citation_line(no: Column, name: Column, chapter: Column) -> Column:
    """First header line: what a reader would cite. Expects tidy fields."""
    doc_type = F.col("doc_type")
    tag = F.concat(F.lit("["), _label(doc_type, "문서"), F.lit("] "))
    # Case: court, date and number, then kind and section.
    court = F.concat_ws(" ", "jurisdiction", "effective_from", "case_no")
    case = F.concat_ws(" · ", F.rtrim(F.concat(tag, court)), "law_kind", no)
    # Legal text: title, chapter, article, then date and responsible body.
    position = F.coalesce(F.concat(F.coalesce(no, F.lit("")), F.lit("("), name, F.lit(")")), no)
    body = F.concat(
        F.when(doc_type == "ordinance", "지자체 ").otherwise("소관 "), authority(),
        F.coalesce(F.concat(F.lit(" ("), government_level(), F.lit(")")), F.lit("")),
    )
    legal = F.concat_ws(
        " · ", F.concat(tag, F.concat_ws(" > ", "title", chapter, position)), F.concat(F.lit("시행 "), "effective_from"), body
    )
    return F.when(doc_type == "precedent", case).otherwise(legal)


def context_line(no: Column, name: Column) -> Column:
    """Second header line: one sentence placing the chunk in its document. Never empty."""
    doc_type = F.col("doc_type")
    title = F.coalesce("title", F.lit("문서"))
    quoted = lambda text: F.concat(F.lit("'"), text, F.lit("'"))
    case = F.concat(
        F.lit("이 판례 섹션은 "), F.concat_ws(" ", authority(), quoted(F.coalesce("case_no", title))),
        F.coalesce(F.concat(F.lit("("), "law_kind", F.lit(")")), F.lit("")),
        F.lit(" 판결의 "), quoted(F.coalesce(no, F.lit("본문"))), F.lit("이다."),
    )
    body = F.concat(F.when(doc_type == "ordinance", "지자체 ").otherwise("소관 "), authority())
    notes = F.when(F.col("law_kind").isNotNull() | body.isNotNull(), F.concat_ws(", ", "law_kind", body))
    legal = F.concat(
        F.lit("이 조문은 "), quoted(title), F.coalesce(F.concat(F.lit("("), notes, F.lit(")")), F.lit("")),
        F.lit(" "), _label(doc_type, "법령"), F.lit("의 일부로, "),
        quoted(F.coalesce(name, no, F.lit("해당 조문"))), F.lit("에 관한 사항을 규정한다."),
    )
    return F.when(doc_type == "precedent", case).otherwise(legal)


def payload(unit: Column, no: Column, name: Column, chapter: Column, part_idx: Column,
            license_text: str = DEFAULT_LICENSE) -> Column:
    """Structured metadata stored next to the chunk text. Expects tidy fields."""
    is_local = F.col("doc_type") == "ordinance"
    notes = let(lambda found: F.when(F.size(found) > 0, found), found=amendments_in(F.coalesce(unit["text"], F.lit(""))))
    return F.struct(
        F.col("doc_type").alias("doc_type"),
        F.coalesce("title", F.lit("")).alias("title"),
        "jurisdiction", "law_kind",
        F.coalesce(no, F.lit("")).alias("article_no"),
        name.alias("article_title"), chapter.alias("chapter_path"),
        part_idx.cast("int").alias("part_idx"),
        "effective_from",
        F.lit(None).cast("string").alias("as_of"),
        "source_url",
        F.lit(license_text).alias("license"),
        unit["kind"].alias("kind"),
        F.coalesce(unit["grade"], F.col("trust_grade"), F.lit("A")).alias("trust_grade"),
        F.col("doc_id").alias("doc_id"),
        F.col("doc_id").alias("parent_id"),
        government_level().alias("gov_level"),
        F.when(is_local, F.col("locality")).alias("locality"),
        notes.alias("amendments"),
        unit["link"].alias("attachment_link"),
        unit["pdf"].alias("attachment_pdf"),
        unit["attachment_kind"].alias("attachment_kind"),
    )
