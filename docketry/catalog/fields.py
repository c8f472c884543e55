"""Scalar rules: text clean-up, identifiers, dates, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.catalog import query
from docketry.catalog.data import spread, table
from docketry.functions import ids, text as T
from docketry.functions.dates import registry_date
from docketry.operators.verification import public_url, title_key
from docketry.sources.parsers import bare_title, government_level

# Marks of legal drafting, planted into every text at its sentence ends and commas.
_PLANTED = "replace(replace(text, '. ', '. ① 원고 ○○○ ② '), ', ', ',  <개정 2016. 1. 22.> ')"


def _planted(name="text"):
    return F.replace(
        F.replace(F.col(name), F.lit(". "), F.lit(". ① 원고 ○○○ ② ")), F.lit(", "), F.lit(",  <개정 2016. 1. 22.> ")
    )


@query("normalize_body", rf"""
WITH p AS (SELECT doc_id, {_PLANTED} AS x FROM documents),
a AS (SELECT doc_id, regexp_replace(replace(replace(x, '①', '(1)'), '②', '(2)'), '<\s*(개정|신설)[^>]*>', '', 'g') AS x FROM p),
b AS (SELECT doc_id, regexp_replace(regexp_replace(x, '[○ㅇ]{{2,}}', '[당사자]', 'g'), '[ \t]+', ' ', 'g') AS x FROM a)
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(x, ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'))) AS body
FROM b""")
def normalize_body(spark, folder):
    return spread(table(spark, folder, "documents"), "doc_id").select("doc_id", F.sha2(T.clean_body(_planted()), 256).alias("body"))


@query("extract_amendments", rf"""
SELECT doc_id, CAST(len(regexp_extract_all(x, '<개정[^>]*>')) AS INTEGER) AS notes, array_to_string(regexp_extract_all(x, '<개정[^>]*>'), '|') AS all_notes
FROM (SELECT doc_id, {_PLANTED} AS x FROM documents)""")
def extract_amendments(spark, folder):
    notes = T.amendments_in(_planted())
    return spread(table(spark, folder, "documents"), "doc_id").select(
        "doc_id", F.size(notes).alias("notes"), F.array_join(notes, "|").alias("all_notes")
    )


@query("annotate_numerals", rf"""
WITH p AS (SELECT doc_id, regexp_replace({_PLANTED}, '<개정[^>]*>', '', 'g') AS x FROM documents)
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(
  replace(replace(x, '①', '①(1) '), '②', '②(2) '), '[ \t]+', ' ', 'g'), '[ \t]+\n', chr(10), 'g'))) AS body FROM p""")
def annotate_numerals(spark, folder):
    return spread(table(spark, folder, "documents"), "doc_id").select("doc_id", F.sha2(T.clean_ordinance(T.nfc(_planted())), 256).alias("body"))


@query("mask_parties", r"""
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(replace(replace(text, ' et ', ' △△ '), ' und ', ' ××× '),
  '[○◯⊙]{2,}|[△▲]{2,}|[□■]{3,}|[☆★]{2,}|[×✕]{3,}', '[당사자]', 'g'), '[ \t]{2,}', ' ', 'g'))) AS body FROM documents""")
def mask_parties(spark, folder):
    x = F.replace(F.replace(F.col("text"), F.lit(" et "), F.lit(" △△ ")), F.lit(" und "), F.lit(" ××× "))
    return spread(table(spark, folder, "documents"), "doc_id").select("doc_id", F.sha2(T.clean_case(T.nfc(x)), 256).alias("body"))


@query("shorten_text", """
SELECT conv_id, turn, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || ' …(생략)' ELSE text END AS shown FROM conversations""")
def shorten_text(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", T.shorten(F.col("text"), 400, " …(생략)").alias("shown"))


@query("content_hash", "SELECT doc_id, sha256(nfc_normalize(trim(text))) AS content_hash FROM documents")
def content_hash(spark, folder):
    # Decomposed on the way in: the hash must not notice.
    decomposed = F.replace(F.col("text"), F.lit("é"), F.lit("é"))
    return spread(table(spark, folder, "documents"), "doc_id").select("doc_id", T.content_hash(F.concat(F.lit(" \n"), decomposed, F.lit("\t "))).alias("content_hash"))


@query("record_ids", """
SELECT doc_id AS k, 'LAW:' || doc_id || ':' || lang AS law_id, 'ORD:' || source || ':' || doc_id AS ordinance_id,
  'ADMRULE:' || doc_id AS rule_id, 'PREC:' || doc_id AS case_id,
  'LAW:' || doc_id || ':' || lang || '#제' || (doc_id % 90 + 1) || '조#' || (doc_id % 3) AS chunk_id, 'LAW:' || doc_id || ':' || lang AS parent_id
FROM documents""")
def record_ids(spark, folder):
    k = F.col("doc_id")
    law = ids.doc_id("law", k, F.concat(F.lit(" "), "lang"))
    chunk = ids.chunk_id(law, F.concat(F.lit("제"), (k % 90 + 1).cast("string"), F.lit("조 ")), k % 3)
    return table(spark, folder, "documents").select(
        k.alias("k"), law.alias("law_id"), ids.doc_id("ordinance", F.col("source"), k).alias("ordinance_id"),
        ids.doc_id("admrule", k).alias("rule_id"), ids.doc_id("precedent", k).alias("case_id"),
        chunk.alias("chunk_id"), ids.parent_of_chunk(chunk).alias("parent_id"),
    )


@query("point_ids", """
WITH h AS (SELECT doc_id, sha1(unhex('6c61776b6f7451516472616e74707473') || encode('DOC:' || doc_id || '#' || lang)) AS d FROM documents)
SELECT doc_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-'
  || translate(substr(d, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS point_id
FROM h""")
def point_ids(spark, folder):
    chunk = F.concat(F.lit("DOC:"), F.col("doc_id").cast("string"), F.lit("#"), "lang")
    return table(spark, folder, "documents").select("doc_id", ids.point_id(chunk).alias("point_id"))


@query("article_keys", """
WITH t AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey % 300 + 1 AS a, l_suppkey % 4 AS b FROM lineitem),
x AS (SELECT *, CASE WHEN b > 0 THEN a || '의' || b ELSE CAST(a AS VARCHAR) END AS k FROM t)
SELECT o, n, k AS from_label, k AS from_spaced, k AS from_bare, lpad(CAST(a AS VARCHAR), 4, '0') || lpad(CAST(b AS VARCHAR), 2, '0') AS registry,
  '제' || a || '조' AS stored FROM x""")
def article_keys(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"),
        (F.col("l_partkey") % 300 + 1).cast("string").alias("a"), (F.col("l_suppkey") % 4).alias("b"),
    )
    branch = lambda sep: F.when(F.col("b") > 0, F.concat(F.lit(sep), F.col("b").cast("string"))).otherwise("")
    label = F.concat(F.lit("제"), "a", F.lit("조"), branch("의"))
    spaced = F.concat(F.lit("제 "), "a", F.lit(" 조"), branch(" 의 "), F.lit(" 제1항"))
    bare = F.concat(F.lit(" "), "a", branch("의 "))
    return rows.select(
        "o", "n", ids.article_key(label).alias("from_label"), ids.article_key(spaced).alias("from_spaced"),
        ids.article_key(bare).alias("from_bare"), ids.registry_article(ids.article_key(label)).alias("registry"),
        ids.stored_article(F.concat("a", F.lit("조"))).alias("stored"),
    )


@query("registry_dates", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS compact, strftime(o_orderdate, '%Y-%m-%d') AS dotted,
  strftime(o_orderdate, '%Y-%m') AS short FROM orders""")
def registry_dates(spark, folder):
    day = lambda pattern: F.date_format(F.col("o_orderdate"), pattern)
    return table(spark, folder, "orders").select(
        "o_orderkey", registry_date(day("yyyyMMdd")).alias("compact"), registry_date(day("yyyy.MM.dd")).alias("dotted"),
        registry_date(F.concat(day("yyyy-MM"), F.lit(" "))).alias("short"),
    )


@query("match_keys", r"""
SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS title_key, sha256(regexp_replace(text, '\s+', '', 'g')) AS case_key
FROM documents""")
def match_keys(spark, folder):
    return spread(table(spark, folder, "documents"), "doc_id").select(
        "doc_id", F.sha2(title_key(F.col("text")), 256).alias("title_key"), F.sha2(ids.case_key(F.col("text")), 256).alias("case_key")
    )


@query("public_links", """
SELECT page_id, 'https://www.law.go.kr/DRF/x?id=' || page_id AS only_token_last, 'https://www.law.go.kr/DRF/x?id=' || page_id AS token_first,
  url AS plain FROM pages""")
def public_links(spark, folder):
    i = F.col("page_id").cast("string")
    return table(spark, folder, "pages").select(
        "page_id", public_url(F.concat(F.lit("/DRF/x?id="), i, F.lit("&OC=secret"))).alias("only_token_last"),
        public_url(F.concat(F.lit("/DRF/x?OC=secret&id="), i)).alias("token_first"), public_url(F.col("url")).alias("plain"),
    )


@query("title_peeling", """
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 4 THEN '(' || p_name ELSE p_name END AS title FROM part""")
def title_peeling(spark, folder):
    depth = F.pmod("p_size", F.lit(5))
    raw = F.when(depth == 0, " ( ) ").when(depth == 1, F.concat(F.lit("("), "p_name", F.lit(")"))) \
        .when(depth == 2, F.concat(F.lit("(( "), "p_name", F.lit(" ))"))).when(depth == 3, F.concat(F.lit("（"), "p_name", F.lit("）"))) \
        .otherwise(F.concat(F.lit("(("), "p_name", F.lit(")")))
    return table(spark, folder, "part").select("p_partkey", bare_title(raw).alias("title"))


@query("government_levels", """
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN '광역' WHEN 'AUTOMOBILE' THEN '교육청' WHEN 'MACHINERY' THEN '광역' ELSE '기초' END AS level
FROM customer""")
def government_levels(spark, folder):
    segment = F.col("c_mktsegment")
    area = F.when(segment == "BUILDING", "_본청").when(segment == "AUTOMOBILE", "_교육청").when(segment != "MACHINERY", segment)
    return table(spark, folder, "customer").select("c_custkey", government_level(area).alias("level"))


@query("attachment_labels", """
SELECT p_partkey, '별표' || p_size || CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN '' ELSE '-0' || (p_partkey % 9 + 1) END AS label
FROM part""")
def attachment_labels(spark, folder):
    third = F.pmod("p_partkey", F.lit(3))
    branch = F.when(third == 0, "").when(third == 1, "00").otherwise(F.concat(F.lit("0"), (F.col("p_partkey") % 9 + 1).cast("string")))
    return table(spark, folder, "part").select("p_partkey", ids.attachment_label(F.lit("별표"), F.col("p_size").cast("string"), branch).alias("label"))
