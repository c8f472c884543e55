"""Answer-side queries: citation checks, verification, review, scorecards."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.catalog import query
from docketry.catalog.data import (
    ARTICLES_SQL, CORPUS_SQL, LABEL_QUERIES_SQL, TOKENS_SQL, VECTORS_SQL, corpus, dense_sql, documents, label_queries, table,
)
from docketry.operators import chunking, evaluation, verification
from docketry.operators.lexical import build_index, bm25_top
from docketry.plans import answer, review
from docketry.plans.search import is_small, lookup, search
from docketry.session import stage

TODAY = "2024-01-15"


# --- citations of an answer ---------------------------------------------------

def _whole_conversations(spark, folder):
    """All turns of each conversation as one text."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, folder, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(
        F.array_join(F.transform(ordered, lambda t: t["text"]), "\n").alias("text")
    )


def _conversation_blocks(spark, folder):
    """Turns as numbered context blocks of their conversation."""
    k = F.col("conv_id") * 31 + F.col("turn")
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("query_id"), (F.col("turn") + 1).cast("int").alias("rank"),
        F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"),
        F.concat(F.lit("문서 "), F.col("role")).alias("title"), F.concat(F.lit("제"), (F.col("turn") + 1).cast("string"), F.lit("조")).alias("article_no"),
        F.concat(F.lit("https://example.org/c/"), F.col("conv_id").cast("string")).alias("source_url"), F.col("role").alias("doc_type"),
        F.when(F.col("role") == "system", "B").otherwise("A").alias("trust_grade"),
        F.when(F.pmod(k, F.lit(4)) == 0, None).when(F.pmod(k, F.lit(4)) == 1, "2030-01-01").otherwise("2019-05-01").alias("effective_from"),
    )


_BLOCKS_SQL = """
blocks AS (SELECT conv_id AS query_id, CAST(turn + 1 AS INTEGER) AS rank, conv_id || '#' || turn AS source_id, '문서 ' || role AS title,
  '제' || (turn + 1) || '조' AS article_no, 'https://example.org/c/' || conv_id AS source_url, role AS doc_type,
  CASE WHEN role = 'system' THEN 'B' ELSE 'A' END AS trust_grade,
  CASE (conv_id * 31 + turn) % 4 WHEN 0 THEN NULL WHEN 1 THEN '2030-01-01' ELSE '2019-05-01' END AS effective_from FROM conversations)"""


def _conversation_citations(spark, folder):
    """Every turn cites the turn of double its number; some of those do not exist, some repeat."""
    turn = F.col("turn")
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("query_id"), turn.cast("int").alias("ordinal"),
        F.when(turn % 5 != 4, F.concat_ws("#", F.col("conv_id").cast("string"), F.floor(turn * 3 / 2).cast("string"))).alias("source_id"),
        F.when(turn % 2 == 1, " 제1항 ").alias("location"),
    )


_CITED_SQL = """
cited AS (SELECT conv_id AS query_id, CAST(turn AS INTEGER) AS ordinal, CASE WHEN turn % 5 <> 4 THEN conv_id || '#' || (turn * 3 // 2) END AS source_id,
  CASE WHEN turn % 2 = 1 THEN '제1항' END AS location FROM conversations)"""

_CHECKED_SQL = f"""
WITH {_BLOCKS_SQL}, {_CITED_SQL}, checked AS (
  SELECT c.query_id, c.ordinal, c.source_id, b.title, coalesce(c.location, b.article_no) AS location, b.source_url, b.doc_type,
    b.trust_grade, coalesce(b.effective_from, '') AS effective_from,
    CASE WHEN b.effective_from IS NULL THEN '미상' WHEN b.effective_from > '{TODAY}' THEN '시행예정' ELSE '현행' END AS status,
    CASE WHEN b.trust_grade = 'B' THEN 'yellow' ELSE 'green' END AS trust_flag
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY ordinal) AS n FROM cited WHERE source_id IS NOT NULL) c
  JOIN blocks b ON b.query_id = c.query_id AND b.source_id = c.source_id WHERE n = 1)"""


@query("citation_check", f"""{_CHECKED_SQL}
SELECT *, CASE WHEN trust_grade = 'B' THEN '본문 미확보(메타데이터만)' WHEN status = '시행예정'
  THEN '본문 확보 · 개정 시행일 ' || effective_from || '(현행 여부는 원문 확인 권장)' ELSE '본문 확보' END AS trust_note FROM checked""")
def citation_check(spark, folder):
    return answer.check_citations(_conversation_citations(spark, folder), _conversation_blocks(spark, folder), TODAY)


@query("trust_aggregate", f"""{_CHECKED_SQL}
SELECT q.query_id, CAST(coalesce(round_even(avg(CASE WHEN trust_flag = 'green' THEN 100 WHEN trust_flag IS NOT NULL THEN 60 END), 0), 0) AS INTEGER) AS trust_score
FROM (SELECT DISTINCT query_id FROM blocks) q LEFT JOIN checked c ON c.query_id = q.query_id GROUP BY q.query_id""")
def trust_aggregate(spark, folder):
    blocks = _conversation_blocks(spark, folder)
    checked = answer.check_citations(_conversation_citations(spark, folder), blocks, TODAY)
    return answer.trust_score(blocks.select("query_id").distinct(), checked)


@query("citation_markers", rf"""
WITH {_BLOCKS_SQL}, marks AS (
  SELECT conv_id AS query_id, unnest(regexp_extract_all(x, '\[(\d{{1,3}})\]', 1)) AS m, unnest(range(len(regexp_extract_all(x, '\[(\d{{1,3}})\]', 1)))) AS pos
  FROM (SELECT conv_id, replace(replace(string_agg(text, chr(10) ORDER BY turn), '. ', ' [2]. [11] '), ',', ' [1],[3][2]') AS x FROM conversations GROUP BY conv_id)),
firsts AS (SELECT query_id, CAST(m AS INTEGER) AS n, min(pos) AS pos FROM marks GROUP BY query_id, m),
numbered AS (SELECT query_id, n, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS INTEGER) AS ordinal FROM firsts)
SELECT x.query_id, x.ordinal, b.source_id FROM numbered x JOIN blocks b ON b.query_id = x.query_id AND b.rank = x.n""")
def citation_markers(spark, folder):
    """Cited blocks recovered from the ``[n]`` marks of each whole conversation."""
    opening = _whole_conversations(spark, folder)
    planted = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(" [2]. [11] ")), F.lit(","), F.lit(" [1],[3][2]"))
    answers = opening.select("query_id", planted.alias("answer"))
    return answer.cited_blocks(answers, _conversation_blocks(spark, folder)).drop("location")


@query("grounding_audit", f"""
WITH {_BLOCKS_SQL}, {_CITED_SQL}, named AS (SELECT * FROM cited WHERE source_id IS NOT NULL AND query_id % 3 <> 0),
audit AS (SELECT n.query_id, count(*) AS n, count(*) FILTER (WHERE b.source_id IS NULL) AS bad
  FROM named n LEFT JOIN blocks b ON b.query_id = n.query_id AND b.source_id = n.source_id GROUP BY n.query_id),
a AS (SELECT conv_id AS query_id, bool_or(contains(replace(text, 'stan', '근거 불충분'), '근거 불충분')) AS declared FROM conversations GROUP BY conv_id)
SELECT a.query_id, coalesce(n, 0) AS n_citations, coalesce(bad, 0) = 0 AS citation_ok, coalesce(n, 0) > 0 OR declared AS grounded
FROM a LEFT JOIN audit ON audit.query_id = a.query_id""")
def grounding_audit(spark, folder):
    answers = _whole_conversations(spark, folder).select("query_id", F.replace(F.col("text"), F.lit("stan"), F.lit("근거 불충분")).alias("answer"))
    cited = _conversation_citations(spark, folder).where("source_id IS NOT NULL AND query_id % 3 <> 0")
    shown = _conversation_blocks(spark, folder).select("query_id", F.col("chunk_id").alias("source_id"))
    return evaluation.score_answers(answers, cited, shown)


# --- scorecard ------------------------------------------------------------------

def _golden(spark, folder):
    item, text = F.col("item_id"), F.col("text")
    none = F.array().cast("array<string>")
    return table(spark, folder, "benchmark").select(
        item.alias("query_id"), F.when(item % 3 == 0, "law").alias("expect_doc_type"),
        F.when(item % 4 == 1, F.array(F.lit("en"), F.lit("src7 "))).otherwise(none).alias("expect_title"),
        F.when(item % 2 == 0, F.array(F.split_part(text, F.lit(" "), F.lit(1)), F.split_part(text, F.lit(" "), F.lit(2)))).otherwise(none).alias("expect_keywords"),
        F.when(item % 5 == 0, "제1조").alias("expect_article"),
    )


def _golden_results(spark, folder):
    shown = lambda rows: rows.select(
        F.col("position").alias("doc"), "title", "text", "doc_type",
        F.when(F.col("doc_type") == "precedent", "절1").otherwise("제1조").alias("article_no"),
    )
    docs = shown(documents(spark, folder))
    queries = table(spark, folder, "benchmark").withColumnRenamed("item_id", "query_id")
    ranked = stage(bm25_top(build_index(docs, "doc", "title", "text"), queries, "query_id", "text", 8), "ranked")
    if not is_small(queries, 8):
        return lookup(ranked, docs, "doc", False)
    found = ranked.select(F.col("doc").alias("doc_id")).distinct()
    return ranked.join(shown(documents(spark, folder, found)), "doc")


_SCORED_SQL = f"""
WITH {CORPUS_SQL}, searched AS (SELECT k AS vec_id, title, text FROM corpus),
word_queries AS (SELECT item_id AS query_id, text FROM benchmark), {TOKENS_SQL},
results AS (SELECT * FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM bm25) WHERE rank <= 8),
rows AS (SELECT b.item_id AS query_id, r.rank, b.item_id % 5 = 0 AS wants_article,
    (b.item_id % 3 <> 0 OR c.doc_type = 'law') AND (b.item_id % 4 <> 1 OR contains(c.title, 'en') OR contains(c.title, 'src7 '))
      AND (b.item_id % 2 <> 0 OR contains(c.title || chr(10) || c.text, split_part(b.text, ' ', 1))
        OR contains(c.title || chr(10) || c.text, split_part(b.text, ' ', 2))) AS fits, c.doc_type <> 'precedent' AS article
  FROM benchmark b LEFT JOIN results r ON r.query_id = b.item_id LEFT JOIN corpus c ON c.k = r.vec_id),
scored AS (SELECT query_id, count(rank) AS n_rows, CAST(min(CASE WHEN fits THEN rank END) AS INTEGER) AS rank,
    min(CASE WHEN fits THEN rank END) IS NOT NULL AS hit,
    CASE WHEN bool_or(wants_article) THEN coalesce(bool_or(article), false) END AS article_hit FROM rows GROUP BY query_id)"""


@query("eval_questions", f"{_SCORED_SQL} SELECT * FROM scored")
def eval_questions(spark, folder):
    return evaluation.score_questions(_golden(spark, folder), _golden_results(spark, folder))


@query("eval_scorecard", f"""{_SCORED_SQL}
SELECT count(*) AS n, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS hit_at_k, avg(coalesce(1.0::DOUBLE / rank, 0)) AS mrr,
  avg(CASE WHEN article_hit THEN 1.0 WHEN NOT article_hit THEN 0.0 END) AS article_hit,
  CAST(NULL AS DOUBLE) AS citation_accuracy, CAST(NULL AS DOUBLE) AS grounding FROM scored""")
def eval_scorecard(spark, folder):
    return evaluation.scorecard(evaluation.score_questions(_golden(spark, folder), _golden_results(spark, folder)))


# --- verification ---------------------------------------------------------------

def _citations(spark, folder):
    """One citation per document: right, spaced out, unknown, partial title, or a case number."""
    k, fifth = F.col("position"), F.pmod("position", F.lit(5))
    none = F.lit(None).cast("string")
    law = F.when(fifth == 0, F.col("title")).when(fifth == 1, F.concat(F.lit("  "), F.replace(F.col("title"), F.lit(" "), F.lit("  ")), F.lit(" "))) \
        .when(fifth == 2, F.concat(F.lit("없는 법 "), k.cast("string"))).when(fifth == 3, F.concat(F.col("jurisdiction"), F.lit(" ")))
    case = F.when(k % 2 == 0, F.concat(F.lit("2020 다 "), (k - F.pmod(k, F.lit(4)) + 3).cast("string"))).when(k % 3 == 0, "2019없음1")
    return documents(spark, folder).select(
        k.alias("citation_id"), F.when(fifth == 4, case).alias("case_no"), F.when(fifth != 4, law).otherwise(none).alias("law_name"),
        F.when(k % 7 != 0, F.concat(F.lit("제 "), (k % 12 + 1).cast("string"), F.lit(" 조"), F.when(k % 11 == 0, "의 2").otherwise(""))).alias("article_no"),
    )


def _registry(spark, folder):
    docs = documents(spark, folder)
    laws = docs.groupBy("title", "jurisdiction", "law_kind").agg(F.min("position").alias("position")).select(
        F.col("title").alias("law_name"), F.when(F.col("law_kind") == "de", "연혁").otherwise("현행").alias("status"),
        F.col("title").alias("serial"), F.lit("20200101").alias("effective"),
        F.concat(F.lit("/LSW/x?OC=abc&id="), F.col("position").cast("string")).alias("link"), "position",
    )
    articles = laws.select("serial", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("n")).select(
        "serial", F.col("n").cast("string").alias("article_no"), F.when(F.col("n") % 2 == 0, "20210301").alias("effective")
    )
    cases = docs.where("doc_type = 'precedent' AND position % 8 = 3").select(
        "case_no", F.lit("2021.04.05").alias("decided"), F.concat(F.lit("/P?OC=abc&seq="), F.col("position").cast("string")).alias("link"), "position"
    )
    return laws, articles, cases


_VERIFY_SQL = f"""
WITH {CORPUS_SQL}, {ARTICLES_SQL}, body AS (
  SELECT k, string_agg(article_no || coalesce('(' || article_title || ')', '') || chr(10) || trim(line), chr(10) || chr(10) ORDER BY i) AS t FROM articles GROUP BY k),
cites AS (SELECT k, title, jurisdiction, k % 5 AS f,
    CASE k % 5 WHEN 0 THEN title WHEN 1 THEN title WHEN 2 THEN '없는 법 ' || k WHEN 3 THEN jurisdiction END AS law,
    CASE WHEN k % 5 = 4 THEN CASE WHEN k % 2 = 0 THEN '2020다' || (k - k % 4 + 3) WHEN k % 3 = 0 THEN '2019없음1' END END AS case_key,
    CASE WHEN k % 7 <> 0 THEN (k % 12 + 1) || CASE WHEN k % 11 = 0 THEN '의2' ELSE '' END END AS art FROM corpus),
kinds AS (SELECT *, CASE WHEN case_key IS NOT NULL THEN 'precedent' WHEN law IS NOT NULL THEN 'statute' ELSE 'malformed' END AS kind FROM cites),
first_parent AS (SELECT title, arg_min(k, k) AS k FROM corpus GROUP BY title),
db AS (
  SELECT c.k AS cid, p.k AS pk FROM kinds c JOIN first_parent f ON f.title = c.law JOIN corpus p ON p.k = f.k LEFT JOIN body b ON b.k = p.k
  WHERE kind = 'statute' AND (art IS NULL OR CASE WHEN contains(art, '의')
    THEN contains(coalesce(t, ''), '제' || split_part(art, '의', 1) || '조의' || split_part(art, '의', 2))
    ELSE regexp_matches(coalesce(t, ''), '제' || art || '조($|[^의]|의[^0-9])') END)
  UNION ALL SELECT c.k, p.k FROM kinds c JOIN corpus p ON p.case_no = c.case_key WHERE kind = 'precedent'),
db_facts AS (SELECT cid, source_url AS db_url, effective_from AS db_eff,
    CASE WHEN trust_grade = 'B' OR coalesce(t, '') = '' THEN 'B' ELSE 'A' END AS db_grade
  FROM db JOIN corpus c ON c.k = pk LEFT JOIN body b ON b.k = pk),
laws AS (SELECT title AS name, law_kind, min(k) AS k FROM corpus GROUP BY title, law_kind),
wanted AS (SELECT DISTINCT law FROM kinds WHERE kind = 'statute'),
picks AS (SELECT law, name, law_kind, k FROM (SELECT w.law, l.*, row_number() OVER (PARTITION BY w.law
    ORDER BY CASE WHEN l.name = w.law THEN 0 ELSE 1 END, CASE WHEN l.law_kind = 'de' THEN 1 ELSE 0 END, l.k) AS n
  FROM wanted w JOIN laws l ON contains(l.name, w.law)) WHERE n = 1),
api AS (
  SELECT c.k AS cid, CASE WHEN p.name IS NULL THEN false WHEN c.art IS NULL THEN true ELSE coalesce(TRY_CAST(c.art AS INTEGER) BETWEEN 1 AND 8, false) END AS m,
    coalesce(p.law_kind <> 'de', false) AS cur, 'https://www.law.go.kr/LSW/x?id=' || p.k AS url,
    CASE WHEN p.name IS NOT NULL THEN CASE WHEN TRY_CAST(c.art AS INTEGER) BETWEEN 1 AND 8 AND TRY_CAST(c.art AS INTEGER) % 2 = 0 THEN '2021-03-01' ELSE '2020-01-01' END END AS eff
  FROM kinds c LEFT JOIN picks p ON p.law = c.law WHERE kind = 'statute'
  UNION ALL
  SELECT c.k, r.k IS NOT NULL, true, 'https://www.law.go.kr/P?seq=' || r.k, CASE WHEN r.k IS NOT NULL THEN '2021-04-05' END
  FROM kinds c LEFT JOIN (SELECT k, case_no FROM corpus WHERE k % 8 = 3) r ON r.case_no = c.case_key WHERE kind = 'precedent'),
joined AS (SELECT c.k AS citation_id, c.kind, c.art, c.case_key, d.cid IS NOT NULL AS db_match, d.db_grade, a.m AS api_match,
    CASE WHEN kind = 'malformed' THEN false WHEN coalesce(a.m, false) THEN a.cur ELSE d.cid IS NOT NULL END AS current,
    coalesce(a.url, d.db_url) AS source_url, coalesce(a.eff, d.db_eff) AS effective_from
  FROM kinds c LEFT JOIN db_facts d ON d.cid = c.k LEFT JOIN api a ON a.cid = c.k),
judged AS (SELECT *, CASE WHEN coalesce(NOT api_match, false) THEN false ELSE db_match AND coalesce(effective_from <= '2021-01-01', true) END AS verified,
    CASE WHEN db_match AND db_grade = 'A' THEN 'A' ELSE 'B' END AS grade FROM joined)
SELECT citation_id, kind, verified, CASE WHEN kind <> 'malformed' THEN score END AS trust_score,
  CASE WHEN kind <> 'malformed' THEN CASE WHEN NOT verified THEN 'red' WHEN (coalesce(api_match, false) AND current AND grade = 'A') OR score >= 80 THEN 'green' ELSE 'yellow' END END AS flag,
  grade AS trust_grade, current, source_url, effective_from, '2021-01-01' AS as_of_date,
  CASE WHEN kind = 'precedent' THEN CASE WHEN starts_with(case_key, '2020다') THEN '2020 다 ' || substr(case_key, 6) ELSE case_key END
    WHEN kind = 'statute' THEN '제' || art || '조' END AS location, db_match, api_match
FROM (SELECT *, CASE WHEN NOT verified THEN CASE WHEN db_match THEN 15 ELSE 0 END ELSE
    50 + CASE WHEN coalesce(api_match, false) THEN 30 ELSE 0 END + CASE WHEN current THEN 15 ELSE 0 END + CASE WHEN grade = 'A' THEN 5 ELSE 0 END END AS score FROM judged)"""


@query("verify_citations", _VERIFY_SQL)
def verify_citations(spark, folder):
    docs = documents(spark, folder)
    parents = chunking.parents(docs)
    classified = verification.classify(_citations(spark, folder))
    found = verification.in_corpus(classified, parents)
    return verification.verdict(classified, found, verification.in_registry(classified, *_registry(spark, folder)), "2021-01-01")


@query("verify_citations_offline", _VERIFY_SQL.replace("a.m AS api_match", "CAST(NULL AS BOOLEAN) AS api_match")
       .replace("WHEN coalesce(a.m, false) THEN a.cur ELSE", "ELSE").replace("coalesce(a.url, d.db_url)", "d.db_url")
       .replace("coalesce(a.eff, d.db_eff)", "d.db_eff"))
def verify_citations_offline(spark, folder):
    """The same citations when the registry gives no answer: the corpus alone decides."""
    docs = documents(spark, folder)
    parents = chunking.parents(docs)
    classified = verification.classify(_citations(spark, folder))
    return verification.verdict(classified, verification.in_corpus(classified, parents), None, "2021-01-01")


# --- review -----------------------------------------------------------------------

@query("review_claims", """
SELECT conv_id AS review_id, turn AS ordinal, CAST(n AS INTEGER) AS claim_no, trim(text) || ' 광고 표시 부당한 표시·광고 금지 위반 효능 과장' AS claim_query FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE trim(text) <> '')""")
def review_claims(spark, folder):
    claims = table(spark, folder, "conversations").select(F.col("conv_id").alias("review_id"), F.col("turn").alias("ordinal"), "text")
    return review.usable_claims(claims).select("review_id", "ordinal", "claim_no", review.claim_query(F.col("text")).alias("claim_query"))


@query("review_context", f"""
WITH {VECTORS_SQL}, {LABEL_QUERIES_SQL}, scored AS ({dense_sql("vectors")}),
found AS (
  SELECT query_id, vec_id, rank, 0 AS pass FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
    FROM scored WHERE doc_type IN ('law', 'admrule')) WHERE rank <= 4
  UNION ALL SELECT query_id, vec_id, rank, 1 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 2),
firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id % 2, vec_id ORDER BY query_id, pass, rank) AS n FROM found)
SELECT CAST(query_id % 2 AS INTEGER) AS review_id, CAST(row_number() OVER (PARTITION BY query_id % 2 ORDER BY query_id, pass, rank) AS INTEGER) AS rank, vec_id
FROM firsts WHERE n = 1""")
def review_context(spark, folder):
    claims = label_queries(spark, folder).withColumn("review_id", F.col("query_id") % 2).withColumn("claim_no", F.col("query_id"))
    return review.retrieve(corpus(spark, folder), claims).select("review_id", "rank", "vec_id")


def _issues(spark, folder):
    turn = F.col("turn")
    verdict = F.element_at(F.array(*[F.lit(v) for v in ("위반", "위반소지", "주의", "적정", "unknown")]), (turn % 5 + 1).cast("int"))
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("review_id"), turn.alias("issue_no"), F.concat(F.lit(" "), "text", F.lit(" ")).alias("claim"),
        verdict.alias("verdict"), F.when(turn % 2 == 0, "high").otherwise("severe").alias("severity"),
    )


_ISSUES_SQL = """
issues AS (SELECT conv_id AS review_id, turn AS issue_no, trim(text, ' ' || chr(10)) AS claim,
  CASE turn % 5 WHEN 0 THEN '위반' WHEN 1 THEN '위반소지' WHEN 2 THEN '주의' WHEN 3 THEN '적정' ELSE '확인필요' END AS verdict,
  CASE WHEN turn % 2 = 0 THEN 'high' ELSE 'none' END AS severity FROM conversations)"""


@query("review_issues", f"""WITH {_ISSUES_SQL} SELECT *, CASE verdict WHEN '위반' THEN 0 WHEN '위반소지' THEN 1 WHEN '주의' THEN 2 WHEN '확인필요' THEN 3 ELSE 4 END AS place FROM issues""")
def review_issues(spark, folder):
    return review.by_severity(review.coerce_issues(_issues(spark, folder)))


@query("review_residue", f"""WITH {_ISSUES_SQL}, kept AS (
  SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE turn % 2 = 0 GROUP BY conv_id)
SELECT review_id, issue_no FROM issues JOIN kept ON conv_id = review_id
WHERE verdict IN ('위반', '위반소지') AND claim <> '' AND contains(text, claim)""")
def review_residue(spark, folder):
    """Violations still standing in the rewrite; a rewrite has every other turn of its conversation."""
    turns = F.array_sort(F.collect_list(F.when(F.col("turn") % 2 == 0, F.struct("turn", "text"))))
    rewrites = table(spark, folder, "conversations").groupBy(F.col("conv_id").alias("review_id")).agg(
        F.array_join(F.transform(turns, lambda t: t["text"]), "\n").alias("corrected_copy")
    )
    return review.unresolved(review.coerce_issues(_issues(spark, folder)), rewrites).select("review_id", "issue_no")


@query("review_citations", f"""WITH {_BLOCKS_SQL}, {_CITED_SQL}
SELECT query_id AS review_id, source_id, issue_no, ordinal FROM (
  SELECT query_id, source_id, CAST(ordinal % 3 AS INTEGER) AS issue_no, ordinal,
    row_number() OVER (PARTITION BY query_id, source_id ORDER BY ordinal % 3, ordinal) AS n FROM cited WHERE source_id IS NOT NULL) WHERE n = 1""")
def review_citations(spark, folder):
    cited = _conversation_citations(spark, folder).where("source_id IS NOT NULL").select(
        F.col("query_id").alias("review_id"), "source_id", (F.col("ordinal") % 3).alias("issue_no"), "ordinal"
    )
    return review.all_citations(cited)


@query("review_law_checks", _VERIFY_SQL[:_VERIFY_SQL.index("joined AS")] + """picked AS (SELECT k FROM corpus WHERE doc_type <> 'precedent')
SELECT c.k % 20 AS issue_id, c.k AS ordinal, c.k AS citation_id, c.title, c.doc_type, '제1조' AS location, coalesce(a.url, c.source_url) AS source_url,
  CASE WHEN coalesce(NOT a.m, false) THEN 'B' ELSE c.trust_grade END AS trust_grade, a.m AS api_verified, a.cur AS current
FROM corpus c LEFT JOIN picked p ON p.k = c.k LEFT JOIN api a ON a.cid = p.k""")
def review_law_checks(spark, folder):
    """Registry verdicts carried onto all statutes of each issue."""
    docs = documents(spark, folder)
    k = F.col("position")
    citations = docs.select(
        F.pmod(k, F.lit(20)).alias("issue_id"), k.alias("ordinal"), k.alias("citation_id"), "title", "doc_type",
        F.lit("제1조").alias("location"), "source_url", "trust_grade",
    )
    classified = verification.classify(_citations(spark, folder))
    api = verification.in_registry(classified, *_registry(spark, folder)).select(
        "citation_id", "api_match", F.col("api_current").alias("current"), F.col("api_url").alias("source_url")
    )
    return review.annotate(citations, api)
