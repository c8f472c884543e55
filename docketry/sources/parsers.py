"""The four corpora: files in, documents out.

Splitting is done with SQL regular expressions and array functions inside each
row; the only Python step is reading the YAML head. A file that cannot become a
document keeps its row with a ``reject_reason`` and no ``doc_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import text as T
from docketry.functions.arrays import last_at_or_before, occurrences
from docketry.functions.binding import let, once
from docketry.functions.ids import doc_id
from docketry.operators.dedup import keep_best_revision
from docketry.sources import markdown as M

# Heading patterns of the source formats.
STATUTE_HASH = r"(?mdU)^#{3,6}\s*(제\d+조(?:의\d+)?)[ \t]*(.*?)[ \t]*$"
STATUTE_INLINE = r"(?mdU)^(제\d+조(?:의\d+)?)[ \t]*\(([^)]*)\)"
STATUTE_CHAPTER = r"(?mdU)^#{1,4}\s*(제\d+장(?:의\d+)?)[ \t]*(.*?)[ \t]*$"
STATUTE_SECTION = r"(?mdU)^#{1,4}\s*(제\d+절(?:의\d+)?)[ \t]*(.*?)[ \t]*$"
SUPPLEMENT = r"(?mdU)^##\s*부칙"
HEADING_NOTE = r"(?dU)\s*[<＜].*$"
RULE_INLINE = r"(?mdU)^(제\d+조(?:의\d+)?)\s*(?:\(([^)]*)\))?"
RULE_HASH = r"(?mdU)^#{3,6}\s*(제\d+조(?:의\d+)?)\s*(?:\(([^)]*)\))?"
RULE_CHAPTER = r"(?mdU)^(제\d+장(?:의\d+)?)\s*(.*?)\s*$"
IMAGE_ONLY = r"(?siU)^\s*(?:<img\b[^>]*>\s*(?:</img>)?\s*)+$"
ORDINANCE_HASH = r"(?mdU)^#{3,6}\s*(제\d+조(?:의\d+)?)\s*(?:\(([^)]*)\))?\s*$"
ORDINANCE_INLINE = r"(?mdU)^(제\d+조(?:의\d+)?)\s*\(([^)]*)\)"
ORDINANCE_RESTATED = r"(?U)^\s*(제\d+조(?:의\s*\d+)?)\s*\(([^)]*)\)\s*"
CHAPTER_ONLY = r"(?dU)^제\s*\d+\s*[장절관편](?:의\s*\d+)?.*$"
CASE_SECTION = r"(?mdU)^##\s+(.+?)\s*$"
FILE_DATE = r"_(\d{4}-\d{2}-\d{2})_"
NO_DATE = "0000-00-00"


def _non_blank(value: Column) -> Column:
    return F.when(T.strip(value) != "", T.strip(value))


def bare_title(raw: Column) -> Column:
    """Title without its wrapping parentheses, however many pairs; blank is null."""
    edge = lambda s, at, chars: F.substring(s, F.lit(at), F.lit(1)).isin(*chars)
    wrapped = lambda s: (F.length(s) >= 2) & edge(s, 1, "(（") & edge(s, -1, ")）")
    inner = lambda s: T.strip(F.substring(s, F.lit(2), F.length(s) - 2))

    def peel(first: Column) -> Column:
        peeled = F.aggregate(
            F.sequence(F.lit(1), F.length(first)), first, lambda s, _: F.when(wrapped(s), inner(s)).otherwise(s)
        )
        return F.nullif(F.when(wrapped(first), peeled).otherwise(first), F.lit(""))

    return let(peel, first=T.strip(F.coalesce(raw, F.lit(""))))


def _marks(body: Column, pattern: str) -> Column:
    """Chapter or section headings with their display label and offset."""
    def label(h: Column) -> Column:
        return T.strip(F.concat(h["label"], F.lit(" "), T.strip(F.regexp_replace(h["rest"], HEADING_NOTE, ""))))

    return F.transform(M.spans(body, pattern), lambda h: F.struct(h["start"].alias("start"), label(h).alias("label")))


def _chapter_path(chapters: Column, sections: Column, pos: Column) -> Column:
    """``장 > 절`` in force at ``pos``; a new chapter ends the section before it."""
    def path(chapter: Column, section: Column) -> Column:
        live = F.when(section["start"] > F.coalesce(chapter["start"], F.lit(-1)), section["label"])
        return F.nullif(F.concat_ws(" > ", chapter["label"], live), F.lit(""))

    return let(path, chapter=last_at_or_before(chapters, pos), section=last_at_or_before(sections, pos))


def statute_articles(df: DataFrame) -> DataFrame:
    """Add ``articles`` from ``body``: headed articles, else inline ones, else the lead text."""
    none = F.lit(None).cast("string")
    empty = F.array().cast(f"array<{M.ARTICLE_TYPE}>")
    has_text = lambda h: T.strip(h["text"]) != ""

    def headed(hits: Column, chapters: Column, sections: Column) -> Column:
        return F.transform(F.filter(hits, has_text), lambda h: M.article(
            h["label"], bare_title(h["rest"]), T.strip(h["text"]), _chapter_path(chapters, sections, h["start"])
        ))

    def without_headings(main: Column) -> Column:
        lead = T.strip(F.regexp_replace(main, r"(?sU)^(.*?)(?m:^#\s+[^\n]*$)", "$1"))
        inline = F.filter(M.spans(main, STATUTE_INLINE), has_text)
        plain = lambda hits: F.transform(hits, lambda h: M.article(h["label"], bare_title(h["rest"]), T.strip(h["text"])))
        whole = lambda text: F.when(text != "", F.array(M.article(F.lit("본문"), none, text))).otherwise(empty)
        return let(lambda hits, text: F.when(F.size(hits) > 0, plain(hits)).otherwise(whole(text)), hits=inline, text=lead)

    def articles(b: Column) -> Column:
        main = F.get(F.split(b, SUPPLEMENT, 2), F.lit(0))
        by_heading = let(
            headed, hits=M.spans(b, STATUTE_HASH), chapters=_marks(b, STATUTE_CHAPTER), sections=_marks(b, STATUTE_SECTION)
        )
        return F.when(b.rlike(STATUTE_HASH), by_heading).otherwise(let(without_headings, main=main))

    return df.withColumn("articles", once(F.coalesce(let(articles, b=F.col("body")), empty)))


def parse_statutes(files: DataFrame) -> DataFrame:
    """National statutes: one document per file."""
    df = statute_articles(M.split_head(files))
    law_id, kind = M.scalar("법령ID"), M.scalar("법령구분")
    ministries = M.list_of("소관부처")
    reason = (
        F.when(~F.col("has_head") | F.col("meta").isNull(), "no readable head")
        .when(law_id.isNull() | kind.isNull(), "law id or kind missing")
    )
    return M.as_document(df.select(
        "path", "articles", "meta",
        reason.alias("reject_reason"),
        doc_id("law", law_id, kind).alias("doc_id"),
        F.lit("law").alias("doc_type"),
        F.coalesce(M.scalar("제목"), F.lit("")).alias("title"),
        F.lit("국가").alias("jurisdiction"),
        kind.alias("law_kind"),
        M.scalar("시행일자").alias("effective_from"),
        M.scalar("출처").alias("source_url"),
        F.when(F.size("articles") > 0, "A").otherwise("B").alias("trust_grade"),
        M.attachments().alias("attachments"),
        F.get(ministries, F.lit(0)).alias("authority"),
    ))


def ordinance_articles(df: DataFrame) -> DataFrame:
    """Add ``articles``: an article label restated inside its text overrides the heading."""
    def restated(segment: Column) -> Column:
        return F.regexp_replace(F.regexp_extract(segment, ORDINANCE_RESTATED, 1), r"(?U)\s+", "")

    def without_restatement(segment: Column, no: Column) -> Column:
        times = F.regexp_count(segment, F.lit(r"(?U)제\d+조(?:의\s*\d+)?\s*\("))
        drop = lambda s: F.when(restated(s) == no, F.regexp_replace(s, ORDINANCE_RESTATED, "")).otherwise(s)
        return F.aggregate(F.sequence(F.lit(1), times), segment, lambda s, _: drop(s))

    def resolve(h: Column) -> Column:
        return let(
            lambda own: F.struct(
                F.when(own != "", own).otherwise(h["label"]).alias("no"),
                _non_blank(F.when(own != "", F.regexp_extract(h["text"], ORDINANCE_RESTATED, 2)).otherwise(h["rest"])).alias("title"),
                F.when(own != "", without_restatement(h["text"], own)).otherwise(h["text"]).alias("raw"),
            ),
            own=restated(h["text"]),
        )

    def as_is(h: Column) -> Column:
        return F.struct(
            h["label"].alias("no"), _non_blank(h["rest"]).alias("title"), F.concat(h["match"], h["text"]).alias("raw")
        )

    found = let(
        lambda b: F.when(b.rlike(ORDINANCE_HASH), F.transform(M.spans(b, ORDINANCE_HASH), resolve))
        .otherwise(F.transform(M.spans(b, ORDINANCE_INLINE), as_is)),
        b=F.col("body"),
    )
    df = df.withColumn("found", found).withColumn("raws", T.nfc_each(F.transform("found", lambda a: a["raw"])))

    def finish(z: Column) -> Column:
        a = z["found"]
        return let(
            lambda notes: M.article(
                a["no"], a["title"], T.clean_ordinance(z["raws"]), amendments=F.when(F.size(notes) > 0, notes)
            ),
            notes=F.regexp_extract_all(z["raws"], F.lit(T.ORDINANCE_NOTE), F.lit(0)),
        )

    phantom = lambda a: (a["article_no"] == "제0조") & a["text"].rlike(CHAPTER_ONLY)
    built = F.transform(F.arrays_zip("found", "raws"), finish)
    kept = F.filter(built, lambda a: (a["text"] != "") & ~phantom(a))
    empty = F.array().cast(f"array<{M.ARTICLE_TYPE}>")
    return df.withColumn("articles", once(F.coalesce(kept, empty))).drop("found", "raws")


def government_level(area: Column) -> Column:
    """광역, 교육청 or 기초 from the second-level area name."""
    return (
        F.when(area.isNull() | (area == "_본청"), "광역").when(area == "_교육청", "교육청").otherwise("기초")
    )


def parse_ordinances(files: DataFrame) -> DataFrame:
    df = ordinance_articles(M.split_head(files))
    region = F.try_variant_get("meta", "$['지자체구분']['광역']", "string")
    area = T.blank_to_null(F.try_variant_get("meta", "$['지자체구분']['기초']", "string"))
    ident, name, wide = M.scalar("자치법규ID"), M.scalar("자치법규명"), T.blank_to_null(region)
    level = government_level(area)
    reason = (
        F.when(~F.col("has_head") | F.col("meta").isNull(), "no readable head")
        .when(ident.isNull() | name.isNull() | wide.isNull(), "id, name or region missing")
    )
    return M.as_document(df.select(
        "path", "articles", "meta",
        reason.alias("reject_reason"),
        doc_id("ordinance", wide, ident).alias("doc_id"),
        F.lit("ordinance").alias("doc_type"),
        name.alias("title"), wide.alias("jurisdiction"),
        M.scalar("자치법규종류").alias("law_kind"),
        M.scalar("시행일자").alias("effective_from"),
        M.scalar("출처").alias("source_url"),
        F.when(F.size("articles") > 0, "A").otherwise("B").alias("trust_grade"),
        M.attachments().alias("attachments"),
        M.scalar("지자체기관명").alias("authority"),
        level.alias("gov_level"),
        F.when(level == "기초", area).alias("locality"),
        M.scalar("자치법규일련번호").alias("serial"),
    ))


def rule_articles(df: DataFrame) -> DataFrame:
    """Add ``articles`` and ``label_only``; repeated labels become ``label#2``, ``label#3``…"""
    empty = F.array().cast(f"array<{M.ARTICLE_TYPE}>")
    df = df.withColumn("body", T.strip(T.nfc(F.col("body"))))

    def numbered(hits: Column, nths: Column, chapters: Column) -> Column:
        def build(h: Column, i: Column) -> Column:
            nth = F.get(nths, i)
            no = F.when(nth > 1, F.concat(h["label"], F.lit("#"), nth.cast("string"))).otherwise(h["label"])
            chapter = last_at_or_before(chapters, h["start"])["label"]
            return let(
                lambda no, title: M.article(no, title, F.coalesce(_non_blank(h["text"]), title, no), chapter),
                no=no, title=_non_blank(h["rest"]),
            )

        return F.transform(hits, build)

    def split(b: Column, pattern: str) -> Column:
        with_labels = lambda hits: let(
            numbered, hits=hits, nths=occurrences(F.transform(hits, lambda h: h["label"])), chapters=_marks(b, RULE_CHAPTER)
        )
        return let(with_labels, hits=M.spans(b, pattern))

    def articles(b: Column) -> Column:
        whole = F.array(M.article(F.lit("전문"), F.lit(None).cast("string"), b))
        return (
            F.when((T.strip(b) == "") | b.rlike(IMAGE_ONLY), empty)
            .when(b.rlike(RULE_INLINE), split(b, RULE_INLINE))
            .when(b.rlike(RULE_HASH), split(b, RULE_HASH))
            .otherwise(whole)
        )

    return df.withColumn("articles", once(F.coalesce(let(articles, b=F.col("body")), empty))) \
        .withColumn("label_only", F.size("articles") == 0)


def parse_rules(files: DataFrame) -> DataFrame:
    """Administrative rules, before revisions are resolved (see :func:`canonical_rules`)."""
    df = rule_articles(M.split_head(files, byte_order_mark=True, full_datetime=True))
    ident = M.scalar("행정규칙ID")
    folder = F.regexp_extract("path", "([^/]+)/[^/]+$", 1)
    ministry = F.coalesce(M.scalar("소관부처명"), M.scalar("상위기관명"))
    reason = (
        F.when(~F.col("has_head") | F.col("meta").isNull(), "no readable head").when(ident.isNull(), "rule id missing")
    )
    return M.as_document(df.select(
        "path", "articles", "meta",
        reason.alias("reject_reason"),
        doc_id("admrule", ident).alias("doc_id"),
        F.lit("admrule").alias("doc_type"),
        F.coalesce(M.scalar("행정규칙명"), folder).alias("title"),
        F.coalesce(ministry, F.lit("행정규칙")).alias("jurisdiction"),
        M.scalar("행정규칙종류").alias("law_kind"),
        F.coalesce(M.scalar("시행일자"), M.scalar("발령일자")).alias("effective_from"),
        M.scalar("출처").alias("source_url"),
        F.when(F.col("label_only"), "B").otherwise("A").alias("trust_grade"),
        M.attachments().alias("attachments"),
        ministry.alias("authority"),
        M.scalar("행정규칙일련번호").alias("serial"),
    ))


def canonical_rules(parsed: DataFrame) -> DataFrame:
    """One document per rule id: the latest, fullest revision."""
    total = F.aggregate("articles", F.lit(0), lambda n, a: n + F.length(a["text"]))
    ranked = keep_best_revision(
        M.accepted(parsed).withColumn("_text_length", total), "doc_id", "serial", "trust_grade", "_text_length", "path"
    )
    return ranked.drop("_text_length", "first_seen")


def case_articles(df: DataFrame) -> DataFrame:
    """Add ``articles``: one per level-two heading, empty sections dropped."""
    df = df.withColumn("found", M.sections(F.col("body"), CASE_SECTION)) \
        .withColumn("raws", T.nfc_each(F.transform("found", lambda h: h["text"])))
    none = F.lit(None).cast("string")
    built = F.transform(
        F.arrays_zip("found", "raws"), lambda z: M.article(T.strip(z["found"]["label"]), none, T.clean_case(z["raws"]))
    )
    kept = F.filter(built, lambda a: (a["article_no"] != "") & (a["text"] != ""))
    empty = F.array().cast(f"array<{M.ARTICLE_TYPE}>")
    return df.withColumn("articles", once(F.coalesce(kept, empty))).drop("found", "raws")


def parse_cases(files: DataFrame) -> DataFrame:
    """Court precedents. Read-me files are not cases."""
    files = files.where(~F.col("path").endswith("/README.md"))
    df = case_articles(M.split_head(files, loose=True, byte_order_mark=True, text_dates=True))
    seq = M.scalar("판례일련번호")
    real = lambda value: F.when((value != "") & (value != NO_DATE), value)
    from_name = F.regexp_extract(F.regexp_extract("path", "([^/]+)$", 1), FILE_DATE, 1)
    reason = (
        F.when(~F.col("has_head") | F.col("meta").isNull(), "no readable head").when(seq.isNull(), "case serial missing")
    )
    return M.as_document(df.select(
        "path", "articles", "meta",
        reason.alias("reject_reason"),
        doc_id("precedent", seq).alias("doc_id"),
        F.lit("precedent").alias("doc_type"),
        F.coalesce(M.scalar("사건명"), M.scalar("사건번호"), seq).alias("title"),
        F.coalesce(M.scalar("법원명"), F.lit("법원미상")).alias("jurisdiction"),
        M.scalar("사건종류").alias("law_kind"),
        F.coalesce(real(M.scalar("선고일자")), real(from_name)).alias("effective_from"),
        M.scalar("출처").alias("source_url"),
        F.when(F.size("articles") > 0, "A").otherwise("B").alias("trust_grade"),
        M.attachments().alias("attachments"),
        M.scalar("법원명").alias("authority"),
        M.scalar("사건번호").alias("case_no"),
    ))
